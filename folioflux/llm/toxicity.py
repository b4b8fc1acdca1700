"""Toxicity: a sparse logistic model over a text's words that identity terms can't move.

Counterfactual regularisation: each training text that names a group is copied with the group's
term swapped for others of its kind, and the squared change of the score is part of the loss, so
weight moves from the group's name to the words that make a text toxic. Features are which words
occur in the whole text; the first fit (L1) picks the words, the second (L2) sets their weights.
Both classes weigh the same in the loss, so a score is a chance where half of the texts are toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, trim

#: So many labelled documents of each class are learned from at most, none of over MAX_CHARS.
MAX_TRAIN = 2000
MAX_CHARS = 50_000
#: Words that enter the first fit: the most telling ones by a chi-squared test.
MAX_WORDS = 2000
#: Identity terms, each line's terms swapped among themselves.
IDENTITY_TERMS = """
women men girls boys wives husbands
woman man girl boy wife husband
female male
gay straight lesbian bisexual transgender queer
black white asian latino african european
muslim christian jewish hindu buddhist atheist catholic
muslims christians jews hindus buddhists atheists catholics
immigrants refugees foreigners citizens natives
old young elderly teenage
deaf blind disabled
"""
GROUPS = [line.split() for line in IDENTITY_TERMS.split("\n") if line]
KIN = {term: [x for x in line if x != term] for line in GROUPS for term in line}

#: Training texts that a word must occur in.
LEAST_TEXTS = 5
#: Letters of a stem: inflected and compound forms share what stands first.
STEMS = (3, 4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W_]+")
SCORED = "doc_id long, score double"


def words(text: str | None) -> set[str]:
    """The text's words, and the first STEMS letters of longer words, marked as stems."""
    found = set(WORD.findall(text.lower())) if text else set()
    return found.union(*({w[:k] + "-" for w in found if len(w) > k} for k in STEMS))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _steepness(x: np.ndarray, share: np.ndarray) -> float:
    """The largest eigenvalue of the mean of share * x x' (with the bias), by power iteration."""
    v, found = np.ones(x.shape[1] + 1, x.dtype), 0.0
    for _ in range(30 if x.any() else 0):
        v /= np.linalg.norm(v)
        along = share * (x @ v[:-1] + v[-1])
        v = np.append(x.T @ along, along.sum()) / len(x)
        found = float(np.linalg.norm(v))
    return 1.1 * found


def _fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, delta: np.ndarray, l1: float, l2: float, swap: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on log loss + l1 |w| + l2 |w|^2 + swap * mean (delta w)^2."""
    w, bias, n = np.zeros(x.shape[1], x.dtype), x.dtype.type(0), max(1, len(x))
    y, share = y.astype(x.dtype), share.astype(x.dtype)
    ahead, ahead_bias, t = w, bias, 1.0
    rate = 1 / (0.25 * _steepness(x, share) + 2 * l2 + 2 * swap * _steepness(delta, np.ones(len(delta), x.dtype)))
    for _ in range(rounds):
        error = share * (_sigmoid(x @ ahead + ahead_bias) - y) / n
        grad = x.T @ error + 2 * l2 * ahead
        if len(delta):
            grad += 2 * swap / len(delta) * (delta.T @ (delta @ ahead))
        new = ahead - rate * grad
        new = (np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)).astype(x.dtype)
        new_bias = ahead_bias - rate * error.sum()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = (new + (t - 1) / t_new * (new - w)).astype(x.dtype), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, bias


def _document_counts(texts: list[str], toxic: np.ndarray) -> tuple[Counter, Counter]:
    """In how many texts, and in how many toxic ones, each word or stem occurs.

    Only those of identity terms and of LEAST_TEXTS texts or more matter. A first pass counts hashes,
    so the second needs no room for the great many rare ones; the counts it gives are exact.
    """
    mask = (1 << 22) - 1
    sketch = np.zeros(mask + 1, np.int32)
    for text in texts:
        bag = words(text)
        np.add.at(sketch, np.fromiter((hash(w) & mask for w in bag), np.int64, len(bag)), 1)
    common = sketch >= LEAST_TEXTS
    seen, bad = Counter(), Counter()
    for text, label in zip(texts, toxic):
        found = [w for w in words(text) if common[hash(w) & mask] or w in KIN]
        seen.update(found)
        if label:
            bad.update(found)
    return seen, bad


class Model:
    """Weights of the words that were picked, and a bias."""

    def __init__(self, texts: list[str], toxic: list[int], swap: float = 1.0) -> None:
        self.weights: dict[str, float] = {}
        self._lookup: tuple[dict, dict] | None = None
        self.bias = -6.0
        held = {}  # equal texts count once; a text with both labels counts as toxic
        for text, label in zip(texts, toxic):
            held[text] = max(label, held.get(text, 0))
        texts, y = list(held), np.array(list(held.values()), float)
        if not len(y) or y.min() == y.max():
            self.bias = 6.0 if len(y) and y[0] else -6.0
            return
        seen, bad = _document_counts(texts, y)
        p, n = y.mean(), len(y)

        def telling(word: str) -> float:
            expected = seen[word] * p
            return (bad[word] - expected) ** 2 / (expected * (1 - p) * (1 - seen[word] / (n + 1)))

        named = [w for w in KIN if w in seen]
        picked = sorted((w for w in seen if seen[w] >= LEAST_TEXTS), key=lambda w: (-telling(w), w))[:MAX_WORDS]
        vocabulary = list(dict.fromkeys([*picked, *named]))
        share = np.where(y > 0, 0.5 / p, 0.5 / (1 - p))
        x, delta = self._matrices(texts, vocabulary)
        w, _ = _fit(x, y, share, delta, l1=0.002, l2=0.0, swap=swap, rounds=200)
        keep = [word for word, v in zip(vocabulary, w) if abs(v) > 1e-3]
        x, delta = self._matrices(texts, keep)
        w, bias = _fit(x, y, share, delta, l1=0.0, l2=1e-5, swap=swap, rounds=3000)
        self.weights, self.bias = dict(zip(keep, map(float, w))), float(bias)

    @staticmethod
    def _matrices(texts: list[str], vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which words occur in each text; and the change that each swap of an identity term makes."""
        column = {w: j for j, w in enumerate(vocabulary)}
        x = np.zeros((len(texts), len(vocabulary)), np.float32)
        swaps = []
        for i, text in enumerate(texts):
            bag = words(text)
            x[i, [column[w] for w in bag if w in column]] = 1
            for term in sorted(bag & KIN.keys()):  # stems end in -, so a term is a whole word
                for other in KIN[term]:
                    change, mine, theirs = np.zeros(len(vocabulary), np.float32), words(term), words(other)
                    change[[column[w] for w in mine - theirs if w in column]] = -1  # the term and its stems
                    change[[column[w] for w in theirs - bag if w in column]] = 1
                    if change.any():
                        swaps.append(change)
        return x, np.array(swaps, np.float32).reshape(len(swaps), len(vocabulary))

    def score(self, text: str | None) -> float:
        if self._lookup is None:  # made once a worker: the words, and the stems by length
            stems = {k: {w[:-1]: v for w, v in self.weights.items() if w[-1] == "-" and len(w) == k + 1} for k in STEMS}
            self._lookup = {w: v for w, v in self.weights.items() if w[-1] != "-"}, {k: v for k, v in stems.items() if v}
        whole, stems = self._lookup
        found = set(WORD.findall(text.lower())) if text else set()
        z = self.bias + sum(whole[w] for w in sorted(found & whole.keys()))
        for k, weights in stems.items():
            starts = {w[:k] for w in found if len(w) > k} & weights.keys()
            z += sum(weights[w] for w in sorted(starts))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", max_rows: int = MAX_TRAIN, max_chars: int = MAX_CHARS) -> Model:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic 0 or 1); pass only rows to learn from.

    A bounded sample, the max_rows labelled ids of each class that come first by a hash, is
    broadcast to the documents and fitted on the driver; texts longer than max_chars are passed
    over. Rows with a null id, label or text teach nothing; an id labelled twice counts as toxic
    if one label says so, and of texts that share an id the first in their order is taken. With one
    class only, or nothing, to learn from, every text gets the same score.
    """
    known = labels.filter(f"{doc_id} is not null and toxic in (0, 1)").groupBy(F.col(doc_id).alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    place = F.row_number().over(Window.partitionBy("_toxic").orderBy(F.xxhash64("_id", F.lit("sample")), "_id"))  # cut to max_rows a task before the shuffle
    drawn = known.withColumn("_place", place).filter(F.col("_place") <= max_rows).select("_id", "_toxic")
    text = docs.select(F.col(doc_id).alias("_id"), F.col("text").alias("_text")).filter(F.length("_text").between(1, max_chars))
    rows = text.join(F.broadcast(drawn), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).select("_text", "_toxic").toArrow()
    pairs = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    del rows
    model = Model([a for a, _ in pairs], [b for _, b in pairs])
    del pairs
    trim()
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): the chance that a whole text is toxic, from the text alone.

    A null or empty text gets the score of a text without any telling word; very long ones are read
    whole. Repeated rows give a row each, equal texts the same score; an empty table gives no rows;
    other columns are not read, whatever their names. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
        trim()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCORED)
