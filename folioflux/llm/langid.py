"""Language ID in two steps: the family first, then one-versus-one linear SVMs within it.

Features are the relative frequencies of hashed character n-grams (one to three characters of the
lower-cased text, every non-letter counting as a space). A linear decision is then the mean of
the n-grams' weights plus a bias, so a whole text of any length is scored in one pass of numpy
over its code points, without building its feature vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, trim

#: Hashed n-grams.
DIMS = 1 << 13
#: So many labelled texts are learned from at most, shared evenly among the languages; but of each
#: language LEAST_EACH, and of more languages than MAX_LANGS none (an error).
MAX_TRAIN = 1200
LEAST_EACH = 10
MAX_LANGS = 500
#: Code points handled at once.
BLOCK = 1 << 18
#: Families of ISO 639-1 codes. A code in none of them is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk uz",
    "indic": "bn gu hi mr ne pa si ur",
}
UNDETERMINED = "und"

PREDICTED = "doc_id long, lang_pred string, score double, family string"


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes.split()), lang)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to itself if it is a letter, else to 0."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[[not chr(c).isalpha() for c in range(0x110000)]] = 0
    return out


def _hashed(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and presence of the n-grams that start at each code point; spaces alone don't count.

    codes ends with two zeros more than there are starts.
    """
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    for k, (gram, holds) in enumerate((
        (a * np.uint32(2654435761), a != 0),
        (a * np.uint32(2246822519) + b * np.uint32(3266489917), (a != 0) | (b != 0)),
        (a * np.uint32(668265263) + b * np.uint32(374761393) + c * np.uint32(2654435789), (a != 0) | (b != 0) & (c != 0)),
    )):
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(2246822519 + 2 * k)
        yield gram >> np.uint32(32 - DIMS.bit_length() + 1), holds


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document numbers, starts, codes): runs of documents of about BLOCK code points in all.

    A longer document comes in several blocks that overlap by the two code points an n-gram
    reaches ahead, so its sums over the blocks are those of the whole text.
    """
    table, parts, numbers, held = _letters(), [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in parts])
        return np.array(numbers), np.concatenate([[0], sizes.cumsum()[:-1]]), np.concatenate([*parts, np.zeros(2, np.uint32)])

    for k, text in enumerate(texts):
        codes = table[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(2, np.uint32)])
        for at in range(0, len(codes), BLOCK):
            piece = codes[at : at + BLOCK]
            if at + BLOCK < len(codes):  # its n-grams see what comes next
                yield np.array([k]), np.array([0]), codes[at : at + BLOCK + 2]
                continue
            parts.append(piece)
            numbers.append(k)
            held += len(piece)
            if held >= BLOCK:
                yield out()
                parts, numbers, held = [], [], 0
    if parts:
        yield out()


def features(texts: list[str | None]) -> np.ndarray:
    """A row for each text: its n-grams' relative frequencies."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for numbers, starts, codes in _blocks(texts):
        row = np.repeat(np.arange(len(numbers)), np.diff([*starts, len(codes) - 2]))
        for slots, holds in _hashed(codes):
            counts = np.bincount(row[holds] * DIMS + slots[holds], minlength=len(numbers) * DIMS)
            np.add.at(out, numbers, counts.reshape(-1, DIMS).astype(np.float32))
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def means(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the n-grams' mean weights (a column for each decision), and whether it has letters."""
    total, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for numbers, starts, codes in _blocks(texts):
        for slots, holds in _hashed(codes):
            for j in range(weights.shape[1]):
                np.add.at(total[:, j], numbers, np.add.reduceat(weights[slots, j] * holds, starts))
            np.add.at(n, numbers, np.add.reduceat(holds.astype(np.int64), starts))
    return total / np.maximum(n, 1)[:, None], n > 0


def svm(x: np.ndarray, y: np.ndarray, use: np.ndarray | None = None, c: float = 10.0, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-loss linear SVM by dual coordinate descent; y is 1 or -1.

    use: which rows count, all by default.
    """
    rng, used = np.random.default_rng(7), np.arange(len(x)) if use is None else np.flatnonzero(use)
    n, plus = len(used), (y[used] > 0).sum()
    share = np.where(y > 0, n / max(1, 2 * plus), n / max(1, 2 * (n - plus)))
    diag = 1 / (2 * c * share)
    q = np.einsum("ij,ij->i", x, x) + 1 + diag
    alpha, w, bias = np.zeros(len(x)), np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(used):
            step = max(-alpha[i], (1 - y[i] * (x[i] @ w + bias) - diag[i] * alpha[i]) / q[i])
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


class Model:
    """One decision a family against the rest, and one for each pair of a family's languages."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        """x: the features of the labelled rows; it is scaled in place."""
        self.langs = sorted(set(langs))
        self.families = {f: [g for g in self.langs if family_of(g) == f] for f in sorted({family_of(g) for g in self.langs})}
        lang = np.array(langs)
        scale = 1 / (x.std(axis=0) + 1e-4) if len(x) else np.ones(DIMS)
        x *= scale  # in place: the sample is the driver's largest table
        norm = (float(np.sqrt(np.einsum("ij,ij->i", x, x).mean())) if len(x) else 0.0) or 1.0  # texts without letters have no features
        x /= norm
        decisions = []
        if len(self.families) > 1:
            decisions += [(f, None, svm(x, np.where(np.isin(lang, own), 1.0, -1.0))) for f, own in self.families.items()]
        for own in self.families.values():
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    pair = np.isin(lang, [a, b])
                    decisions.append((a, b, svm(x, np.where(lang == a, 1.0, -1.0), pair)))
        self.names = [(a, b) for a, b, _ in decisions]
        self.weights = np.array([w * scale / norm for _, _, (w, _) in decisions], np.float64).reshape(len(decisions), DIMS).T.astype(np.float32).copy()
        self.bias = np.array([b for _, _, (_, b) in decisions])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, str | None]]:
        if not self.langs:
            return [(UNDETERMINED, 0.0, None)] * len(texts)
        margins, letters = means(texts, self.weights)
        sure = 1 / (1 + np.exp(-np.clip(3 * (margins + self.bias), -30, 30)))
        column = {name: j for j, name in enumerate(self.names)}
        out = []
        for p, holds in zip(sure, letters):
            if not holds:
                out.append((UNDETERMINED, 0.0, None))
                continue
            family = max(self.families, key=lambda f: p[column[f, None]] if (f, None) in column else 1.0)
            score, own = float(p[column[family, None]]) if (family, None) in column else 1.0, self.families[family]
            beats = {a: {b: float(p[column[a, b]] if (a, b) in column else 1 - p[column[b, a]]) for b in own if b != a} for a in own}
            lang = max(own, key=lambda a: (sum(v > 0.5 for v in beats[a].values()), sum(beats[a].values())))
            out.append((lang, min([score, *beats[lang].values()]), family))
        return out


def sample(labelled: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    """(lang, _hash): the texts to learn from, by the hash of the text: exactly as many of each language, where there are enough.

    Different texts are drawn in the order of a hash, so a text that repeats however often counts
    once, and neither order nor partitions matter. A first cut by that hash, some times wider than
    needed, keeps what is shuffled small.
    """
    keyed = labelled.select("lang", F.xxhash64("text", F.lit("sample")).alias("_hash"))
    about = keyed.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(about) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    each = max(LEAST_EACH, max_rows // max(1, len(about)))
    wide: Column = F.lit(0.0)
    for r in about:
        wide = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, (8 * each + 100) / max(1, r["n"])))).otherwise(wide)
    draw = F.pmod("_hash", F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = keyed.filter((draw < wide) | (wide >= 1)).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_hash", F.lit(1 << 30)), "_hash"))
    return near.withColumn("_place", place).filter(F.col("_place") <= each).select("lang", "_hash")


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN) -> Model:
    """Learn from (text, lang): rows with a null lang or no text are left out.

    The sample's features are made on the executors, once a task for each text; the driver gets
    32 KB for each text of the sample. A text labelled in two languages teaches both. Without
    labelled rows the model knows no language and predicts und.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select("text", "lang").filter("lang is not null and text is not null and length(text) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            first = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]
            for at in range(0, len(first), 100):
                part = batch.take(pa.array(first[at : at + 100]))
                x = features(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "_hash", "x"])
        trim()

    drawn = F.broadcast(sample(rows, max_rows))  # max_rows rows, or LEAST_EACH a language
    chosen = rows.withColumn("_hash", F.xxhash64("text", F.lit("sample"))).join(drawn, ["lang", "_hash"]).select("text", "lang", "_hash")
    made = chosen.mapInArrow(run, "lang string, _hash long, x binary")
    got = made.groupBy("lang", "_hash").agg(F.min("x").alias("x")).toArrow()  # a text that several tasks hold
    langs, hashes, vectors = got.column("lang").to_pylist(), got.column("_hash").to_pylist(), got.column("x")
    order = sorted(range(len(langs)), key=lambda i: (langs[i], hashes[i]))
    x = np.empty((len(langs), DIMS), np.float32)
    for k, i in enumerate(order):
        x[k] = np.frombuffer(vectors[i].as_buffer(), np.float32)
    del got, vectors
    model = Model(x, [langs[i] for i in order])
    del x
    trim()
    return model


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, family) for every whole text, from the text alone.

    und with score 0 where the text is null, empty or without letters; very long texts are scored
    in blocks. Repeated rows give a row each, equal ones the same prediction; an empty table gives
    no rows; other columns are not read, whatever their names. A tie goes to the first in
    alphabetical order. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, family = zip(*shared.value.predict(batch.column(1).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(family, pa.string())], names=["doc_id", "lang_pred", "score", "family"])
        trim()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PREDICTED)


def accepted(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows, all columns, whose language is one that the model knows, with a score of `least`.

    Rows that predict() calls und go. The prediction is a column beside the rows, so rows without
    an id, or that share one, are each judged by their own text. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        found = shared.value.predict([None if x is None else str(x) for x in texts])
        out = pd.Series([lang != UNDETERMINED and score >= least for lang, score, _ in found], dtype=bool)
        trim()
        return out

    return docs.filter(keeps(F.col(text)))
