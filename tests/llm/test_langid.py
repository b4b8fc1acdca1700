import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.llm import langid
from folioflux.llm.common import held_out

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(SF).filter(held_out(F.col("doc_id"), 5) != 0))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(SF).filter((held_out(F.col("doc_id"), 5) == 0) & F.col("lang").isNotNull())
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == len(truth) and sum(got[k]["lang_pred"] == v for k, v in truth.items()) / len(truth) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["family"] for r in got.values()} == {"germanic", "romance"}


def test_edges(model, odd, none):
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] is not None}
    assert by_id[3] == by_id[4] == by_id[6] == by_id[7] == ("und", 0.0)
    assert by_id[5][0] == "en" and by_id[8][0] == "de" and by_id[9][0] == "fr"
    assert langid.predict(none, model).count() == 0
    kept = langid.accepted(odd, model, 0.25)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 5, 8, 9, 10}


def test_nothing_to_learn_from(none, odd):
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}
    one = langid.train(odd.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predict(odd, one).collect()} == {"und", "en"}


def test_blocks_do_not_change_the_sums(model, monkeypatch):
    texts = ["le chat est là. " * 400, "the cat is there", None, "der Hund " * 3000]
    whole = model.predict(texts)
    monkeypatch.setattr(langid, "BLOCK", 1000)
    for a, b in zip(whole, model.predict(texts)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-4)


def brute_grams(text):
    """Slots of a text's n-grams, one by one, by the definition: letters, and 0 for all else, with a 0 around."""
    codes = [0] + [ord(c) if c.isalpha() else 0 for c in (text or "").lower()] + [0, 0, 0]
    m, out = (1 << 32) - 1, []
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if codes.count(0) == len(codes):
            break
        for k, (gram, holds) in enumerate((
            (a * 2654435761, a), (a * 2246822519 + b * 3266489917, a or b), (a * 668265263 + b * 374761393 + c * 2654435789, a or b and c),
        )):
            if holds:
                gram &= m
                out.append((((gram ^ gram >> 15) * (2246822519 + 2 * k)) & m) >> 32 - 13)
    return out


def brute_predict(model, text):
    grams = brute_grams(text)
    if not grams:
        return "und", 0.0, None
    sure = {}
    for j, name in enumerate(model.names):
        margin = sum(float(model.weights[g, j]) for g in grams) / len(grams) + model.bias[j]
        sure[name] = 1 / (1 + math.exp(-3 * margin))
    family = max(sorted(model.families), key=lambda f: sure.get((f, None), 1.0))
    own = model.families[family]
    against = {a: [sure[a, b] if (a, b) in sure else 1 - sure[b, a] for b in own if b != a] for a in own}
    lang = max(own, key=lambda a: (sum(v > 0.5 for v in against[a]), sum(against[a])))
    return lang, min([sure.get((family, None), 1.0), *against[lang]]), family


def test_predictions_against_brute_force(spark, model):
    texts = [r["text"] for r in spark.read.parquet(SF).filter("length(text) < 1500").orderBy("doc_id").limit(60).collect()]
    texts += [None, "", "12 34", "é", "Straße, naïve 日本語 text", "a", " x", "\x00", "ǅ ſ İ"]
    for text, got in zip(texts, model.predict(texts)):
        want = brute_predict(model, text)
        assert got[0] == want[0] and got[2] == want[2] and got[1] == pytest.approx(want[1], abs=1e-4)


def test_svm_reaches_the_least_loss():
    """No step along any direction lowers the stated objective by more than a hair."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0.4, 1.0, -1.0)
    share = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    loss = lambda w, b: (w @ w + b * b) / 2 + 10 * (share * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()
    w, b = langid.svm(x, y, epochs=3000)
    for _ in range(300):
        d = rng.normal(size=6) * 10 ** rng.uniform(-4, 0)
        assert loss(w + d[:5], b + d[5]) > loss(w, b) * (1 - 1e-3)


def test_the_sample_is_bounded_and_even(spark):
    rows = [("one hot text", "en")] * 3000 + [(f"english text {k}", "en") for k in range(700)] + [(f"texte {k}", "fr") for k in range(30)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = langid.sample(df, 200)
    assert {r["lang"]: r["n"] for r in got.groupBy("lang").agg(F.count("*").alias("n")).collect()} == {"en": 100, "fr": 30}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, langid.sample(df.repartition(2), 200).collect()))
    many = spark.createDataFrame([(f"{a} {b}", f"x{a}") for a in range(150) for b in range(3)], "text string, lang string")
    assert langid.sample(many, 200).count() == 450  # none of 150 languages goes without
    assert len(langid.train(many.filter("lang in ('x1', 'x2')")).langs) == 2
