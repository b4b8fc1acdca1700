import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.llm import toxicity
from folioflux.llm.common import held_out

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels.filter(held_out(F.col("doc_id"), 3) != 1))


def test_held_out(spark, model):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(held_out(F.col("doc_id"), 3) == 1).select("doc_id", "toxic")
    got = toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), model).join(labels, "doc_id").collect()
    hit = [r["score"] >= 0.7 for r in got if r["toxic"] == 1]
    wrong = [r["score"] >= 0.7 for r in got if r["toxic"] == 0]
    assert sum(hit) / len(hit) > 0.8 and sum(wrong) / len(wrong) < 0.02  # some of these labels are noise


def test_edges(model, odd, none):
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["score"] for r in got}[3] < 0.5
    assert toxicity.score(none, model).count() == 0


def test_swaps_take_weight_from_identity_terms():
    texts = [f"those women are {w} n{k}" for k, w in enumerate(["awful"] * 30)] + [f"those people are fine n{k}" for k in range(30)] + ["awful people"] * 1
    toxic = [1] * 30 + [0] * 30 + [1]
    free, held = (toxicity.Model(texts, toxic, swap=s) for s in (0.0, 3.0))
    gap = lambda m: abs(m.score("those women are fine") - m.score("those men are fine"))
    assert gap(held) < gap(free) or gap(free) < 0.01
    assert held.score("those women are fine") < 0.7 < held.score("awful")


def test_little_to_learn_from(spark, none):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "fine"), (2, "x")], "doc_id long, text string")
    assert toxicity.train(docs, labels).score("anything") < 0.5
    assert toxicity.train(none, labels.limit(0)).score(None) < 0.5


def brute_score(model, text):
    """The score by its definition: a word or stem counts once if any word of the text is it, or begins with it."""
    found = re.findall(r"[^\W_]+", (text or "").lower())
    z = model.bias
    for term, weight in model.weights.items():
        if any(w == term if term[-1] != "-" else w.startswith(term[:-1]) and len(w) > len(term) - 1 for w in found):
            z += weight
    return 1 / (1 + math.exp(-z))


def test_scores_against_brute_force(spark, model):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(200).collect()]
    texts += [None, "", " 12_x ", "É é ſ", " ".join(w.rstrip("-") + "zz" for w in model.weights), " ".join(w.rstrip("-") for w in model.weights)]
    for text in texts:
        assert model.score(text) == pytest.approx(brute_score(model, text), abs=1e-9)


def test_the_fit_is_the_least_of_the_stated_loss():
    """Log loss with classes weighed alike, L2, and the swaps' squared score changes: no gradient is left."""
    rng = np.random.default_rng(4)
    x = (rng.random((80, 6)) < 0.4).astype(np.float32)
    y = (x[:, 0] + rng.random(80) > 0.9).astype(float)
    delta = rng.choice([-1.0, 0.0, 1.0], (15, 6)).astype(np.float32)
    p = y.mean()
    share = np.where(y > 0, 0.5 / p, 0.5 / (1 - p))
    w, b = toxicity._fit(x, y, share, delta, l1=0.0, l2=0.01, swap=0.7, rounds=5000)

    def loss(w, b):
        z = x @ w + b
        return (share * (np.logaddexp(0, z) - y * z)).mean() + 0.01 * (w @ w) + 0.7 * ((delta @ w) ** 2).mean()

    for _ in range(300):
        d = rng.normal(size=7) * 10 ** rng.uniform(-3, 0)
        assert loss(w + d[:6], b + d[6]) >= loss(w, b) - 1e-6


def test_the_draw_is_exact_and_ordered(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(toxicity, "Model", lambda texts, toxic: taught.append((texts, toxic)))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(300)] + [(5, "a second text")] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    for k in (1, 4):
        toxicity.train(docs.repartition(k), labels.repartition(k), max_rows=20)
    assert taught[0] == taught[1] and sum(taught[0][1]) == 20 and len(taught[0][0]) == 40
