"""Byte-level BPE: exact merges in linear time from longest matches and checked neighbours.

A sequence of tokens is the one that the merges give exactly if each adjacent pair is: encoding
the two tokens' bytes together gives back those two tokens. So a piece is encoded from left to
right with the longest token that is compatible with the one before it, stepping to shorter
prefixes and back to earlier tokens where none is. A position found to be a dead end is marked
and never entered again, which bounds the steps by the piece's length times the tokens nested in
one another. Bytes are mapped to Latin-1 characters, as pyahocorasick matches strings.
"""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trim

#: Pieces remembered by each Python worker, and as many again of those met before; four times as many
#: token pairs.
MEMO = 200_000

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, n_tokens int, ids array<int>, decoded binary"


def parse(ranks: bytes) -> dict[bytes, int]:
    """A rank file's tokens and their ranks."""
    return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, ranks.splitlines()) if word}


class Words:
    """Ids to bytes, in numpy: every token's bytes in one array, and where each begins."""

    def __init__(self, ranks: bytes) -> None:
        found = sorted((rank, word) for word, rank in parse(ranks).items())
        self.sizes = np.zeros(found[-1][0] + 1 if found else 0, np.int64)
        self.sizes[[rank for rank, _ in found]] = [len(word) for _, word in found]
        self.starts = self.sizes.cumsum() - self.sizes
        self.bytes = np.frombuffer(b"".join(word for _, word in found), np.uint8)

    def decode(self, ids: np.ndarray, block: int = 1 << 16) -> bytes:
        out = []
        for at in range(0, len(ids), block):
            part = ids[at : at + block]
            sizes = self.sizes[part]
            ends = sizes.cumsum()
            places = np.repeat(self.starts[part] - ends + sizes, sizes)
            places += np.arange(len(places))
            out.append(self.bytes[places].tobytes())
        return b"".join(out)


class Bpe:
    """The encoder of one rank file (lines of base64 token and rank) and one splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import ahocorasick
        import regex

        self.rank_of = parse(ranks)
        top = max(self.rank_of.values(), default=-1) + 1
        self.bytes_of = [b""] * top
        for word, rank in self.rank_of.items():
            self.bytes_of[rank] = word
        self.sizes = [len(word) for word in self.bytes_of]
        self.pieces = regex.compile(pattern).findall
        self.shorter = [self._longest_prefix(word) for word in self.bytes_of]
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank in range(top):
            self._learn_halves(rank)
        self.matcher = ahocorasick.Automaton()
        for word, rank in self.rank_of.items():
            self.matcher.add_word(word.decode("latin-1"), rank)
        self.matcher.make_automaton()
        self.reach = max(self.sizes, default=0)
        self._at_path: dict[str, int | None] = {}
        self._apart: dict[int, dict[int, bool]] = defaultdict(dict)  # which tokens may follow which
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _longest_prefix(self, word: bytes) -> int | None:
        return next((self.rank_of[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in self.rank_of), None)

    def _learn_halves(self, rank: int) -> None:
        """The two tokens whose merge makes this one; ranks below are known already."""
        word, left = self.bytes_of[rank], self.shorter[rank]
        while left is not None:
            right = self.rank_of.get(word[self.sizes[left]:])
            if right is not None and left < rank and right < rank and self._stay_apart(left, right):
                self.halves[rank] = (left, right)
                self.merged[left, right] = rank
                return
            left = self.shorter[left]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between two tokens.

        Undo merges on either side of the border, latest first. A merge across the border would
        have come first if its rank is below that of the merge undone last.
        """
        undone = 1 << 60
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < undone:
                return False
            parts_l, parts_r = self.halves.get(left), self.halves.get(right)
            if parts_l and (left > right or not parts_r):
                undone, left = left, parts_l[1]
            elif parts_r:
                undone, right = right + 1, parts_r[0]  # on equal ranks the left merge comes first
            else:
                return True

    def _longest(self, text: str) -> int | None:
        """The longest token at the start of `text` (the string form of a few bytes)."""
        path = text[: self.matcher.longest_prefix(text)]
        found = self._at_path.get(path)
        if found is None:
            found = next((self.rank_of[word] for k in range(len(path), 0, -1) if (word := path[:k].encode("latin-1")) in self.rank_of), None)
            self._at_path[path] = found  # as many as the trie has nodes, at most
        return found

    def _encode_bytes(self, piece: bytes) -> bytes:
        """One piece's ids, as the bytes of 32-bit numbers."""
        whole = self.rank_of.get(piece)
        if whole is not None:
            return array("i", (whole,)).tobytes()
        sizes, shorter, apart, longest, reach = self.sizes, self.shorter, self._apart, self._longest, self.reach
        text, n, shut = piece.decode("latin-1"), len(piece), None
        tokens: list[int] = []
        at, token, fits_after = 0, longest(text[:reach]), None
        while at < n:
            while token is not None:
                if not shut or at + sizes[token] not in shut:
                    if fits_after is None:
                        break
                    fits = fits_after.get(token)
                    if fits is None:
                        fits = fits_after[token] = self._stay_apart(tokens[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                at += sizes[token]
                token = longest(text[at : at + reach]) if at < n else None
            elif tokens:  # nothing fits here: shut the position and shorten the token before
                if shut is None:
                    shut = set()
                shut.add(at)
                last = tokens.pop()
                at -= sizes[last]
                token = shorter[last]
            else:
                raise ValueError("the rank file lacks single bytes")
            fits_after = apart[tokens[-1]] if tokens else None
        return array("i", tokens).tobytes()

    def _learn(self, piece: str) -> bytes:
        """A piece that the memo lacks: from the older half of the memo, or encoded now."""
        found = self._older.get(piece)
        if found is None:
            found = self._encode_bytes(piece.encode())
        if len(piece) <= 64:
            if len(self._memo) >= MEMO:  # what was not met again since the last time is forgotten
                self._older, self._memo = self._memo, {}
                if sum(map(len, self._apart.values())) >= 4 * MEMO:
                    self._apart.clear()
            self._memo[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """A text's ids, as the bytes of 32-bit numbers."""
        known, learn = self._memo.get, self._learn
        out = []
        for piece in self.pieces(text):
            found = known(piece)
            if found is None:
                found = learn(piece)
                known = self._memo.get
            out.append(found)
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(ranks: bytes, pattern: str) -> Bpe:
    """One per Python worker."""
    return Bpe(ranks, pattern)


@lru_cache(maxsize=1)
def vocabulary(ranks: bytes) -> Words:
    """One per Python worker."""
    return Words(ranks)


def _encoded(bpe: Bpe, texts: pa.Array) -> pa.ListArray:
    ids = [bpe.encode(x.as_py() or "") for x in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def _decoded(words: Words, ids: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """How many ids each list has, and the bytes that they stand for."""
    ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    out = [words.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
    return pa.array(np.diff(ends).astype(np.int32)), pa.array(out, pa.binary())


def encode(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): every whole text's token ids, without special tokens.

    ranks: the rank file's content, a few MB, sent to the executors once by broadcast; so no
    executor needs the file. A null text counts as empty and gives no ids; repeated rows give a
    row each; other columns are not read. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _encoded(bpe, batch.column(1))], names=["doc_id", "ids"])

    return _texts(docs, doc_id, text).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the bytes that ids stand for; null ids count as none."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_with_bytes(batch.column(1), words)], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, DECODED)


def _with_bytes(ids: pa.ListArray, words: Words) -> list[pa.Array]:
    sizes, out = _decoded(words, ids)
    return [sizes, ids, out]


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """decode(encode(docs)) in one Python worker: the ids cross over to the JVM once."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, words = encoder(shared.value, pattern), vocabulary(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_with_bytes(_encoded(bpe, batch.column(1)), words)], names=["doc_id", "n_tokens", "ids", "decoded"])
        trim()

    return _texts(docs, doc_id, text).mapInArrow(run, DECODED)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the digests of its ids and of the decoded bytes."""
    return round_trip(docs, ranks, pattern).select(
        "doc_id",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
