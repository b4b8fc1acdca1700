import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from folioflux.llm import bpe
from folioflux.llm.queries import ranks

RANKS, PATTERN = ranks()


@pytest.fixture(scope="module")
def reference():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def ids(encoder, text):
    import numpy as np

    return np.frombuffer(encoder.encode(text), np.int32).tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_random_texts(name):
    with open(public_tokenizers.path(name), "rb") as f:
        data = f.read()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    mine, words, rng = bpe.Bpe(data, PATTERN), bpe.Words(data), random.Random(7)
    alphabet = [chr(c) for c in range(0x250)] + list("\u1680\u180e\u2028\u3000\u200b\ufeff中文😀٠Ⅷกำ") + list("aehotn 's\n\t12ll") * 40
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        got = ids(mine, text)
        assert got == known.encode_ordinary(text)
        import numpy as np

        assert words.decode(np.array(got, np.int32)) == text.encode()


def test_long_pieces(reference):
    mine = bpe.Bpe(RANKS, PATTERN)
    for text in ("a" * 5000, "abaaab" * 1000, "ab" * 3000 + "ba" * 3000, " " * 4000, "=" * 3000):
        assert ids(mine, text) == reference.encode_ordinary(text)
    assert len(mine.encode("ab" * 200_000)) > 0  # linear: no time to speak of


def test_memo_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    mine = bpe.Bpe(RANKS, PATTERN)
    text = " ".join(f"word{k}ing" for k in range(300)) * 2
    assert ids(mine, text) == reference.encode_ordinary(text)
    assert len(mine._memo) <= 10 and len(mine._older) <= 10


def test_rows(odd, none, reference):
    want = []
    for r in odd.collect():
        text = r["text"] or ""
        tokens = reference.encode_ordinary(text)
        want.append((str(r["doc_id"]), len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = bpe.digests(odd, RANKS, PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    apart = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in apart) == sorted((r["text"] or "").encode() for r in odd.collect())
    assert bpe.digests(none, RANKS, PATTERN).count() == 0
