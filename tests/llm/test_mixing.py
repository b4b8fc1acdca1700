import math

import pytest
from pyspark.sql import functions as F

from folioflux.llm import mixing


def test_rates_reach_the_weights(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").alias("source"))
    mixed = mixing.mix(docs, {"hot": 1.0, "b": 2.0}, default=3.0)
    n = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, w in (("hot", 1), ("b", 2), (None, 3)):
        assert n[source] == pytest.approx(40_000 * w / 6, rel=0.03)
    rate = mixed.filter("source = 'b'").first()["_rate"]
    counts = {r["_copies"]: r["n"] for r in mixed.filter("source = 'b' and _copy = 0").groupBy("_copies").agg(F.count("*").alias("n")).collect()}
    for k in (1, 2, 3):
        assert counts[k] == pytest.approx(13_333 * math.exp(-rate) * rate**k / math.factorial(k), rel=0.1)


def test_copies_are_whole_deterministic_and_spread(spark, odd):
    a, b = (mixing.mix(odd.repartition(k), {"a": 5.0}, scale=4.0).drop("_rate") for k in (1, 5))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert set(odd.columns) <= set(a.columns) and "_copy" in odd.columns
    plain = mixing.mix(odd.drop("_copy", "_key", "_first"), {"a": 5.0}, scale=4.0)
    for r in plain.groupBy("doc_id", "text").agg(F.countDistinct("_copy").alias("n"), F.max("_copies").alias("m"), F.max("_copy").alias("last")).collect():
        assert r["n"] == r["m"] == r["last"] + 1


def test_large_and_zero_rates(spark, none):
    of = spark.createDataFrame([("1a", 2000.0), ("1b", 0.0), ("1c", 0.01)], "_key string, rate double")
    got = {r["_key"]: r["cdf"] for r in mixing.distributions(of).collect()}
    assert got["1a"][-1] == pytest.approx(1) and sum(1 for c in got["1a"] if c <= 0.5) == pytest.approx(2000, abs=3)
    assert set(got["1b"]) == {1.0} and got["1c"][0] == pytest.approx(math.exp(-0.01))
    assert mixing.mix(none.select("doc_id", "text", "source"), {}).count() == 0


def poisson(rate, u):
    """The least k whose cumulative probability is over u, summed outwards from near the mean."""
    k = max(0, int(rate - 14 * math.sqrt(rate)))
    total = 0.0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if total > u:
            return k
        k += 1


def test_quantiles_of_large_rates(spark):
    grid = [(rate, (k + 0.5) / 400) for rate in (1000.5, 5000.0, 1e5) for k in range(400)] + [(1e4, u) for u in (1e-9, 1e-4, 0.999, 1 - 1e-9)]
    df = spark.createDataFrame(grid, "rate double, u double")
    off = [r["k"] - poisson(r["rate"], r["u"]) for r in df.select("rate", "u", mixing.large_quantile(F.col("rate"), F.col("u")).alias("k")).collect()]
    assert max(map(abs, off)) <= 1 and sum(map(bool, off)) / len(off) < 0.02
    edge = spark.createDataFrame([(3e9, 0.0), (3e9, 0.5)], "rate double, u double").select(mixing.large_quantile(F.col("rate"), F.col("u")).alias("k")).collect()
    assert edge[0]["k"] < edge[1]["k"] == pytest.approx(3e9, abs=2)


def test_a_tiny_source_beside_a_large_one(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "ab", "tiny"), (2, "x" * 30_000, "large"), (3, "y" * 30_000, "large")], "doc_id long, text string, source string")
    want = {(r["doc_id"], r["_copies"]) for r in mixing.mix(docs, {}).collect()}
    monkeypatch.setattr(mixing, "BLOCK", 1000)
    got = mixing.mix(docs, {}).collect()
    assert {(r["doc_id"], r["_copies"]) for r in got} == want
    tiny = [r["_copy"] for r in got if r["doc_id"] == 1]
    assert len(tiny) == pytest.approx(15_000, abs=800) and sorted(tiny) == list(range(len(tiny)))
    very = spark.createDataFrame([("1a", 3e9)], "_key string, rate double")
    assert mixing.distributions(very).first()["cdf"] == []


def test_many_sources_are_joined_without_a_large_broadcast(spark, monkeypatch):
    from folioflux.llm import common

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 97)).alias("source"))
    want = sorted(map(str, mixing.mix(docs, {"hot": 2.0}).collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 5)
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    assert sorted(map(str, mixing.mix(docs, {"hot": 2.0}).collect())) == want


def test_draws_against_brute_force(spark):
    import hashlib

    docs = spark.createDataFrame([(k, "z" * (1 + k % 7), f"s{k % 4}") for k in range(400)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["_copies"] for r in mixing.mix(docs, {"s0": 3.0}, seed=5, scale=2.0).collect()}
    units = {s: sum(1 + k % 7 for k in range(400) if k % 4 == s) for s in range(4)}
    rate = {s: 2 * sum(units.values()) * (3 if s == 0 else 1) / 6 / units[s] for s in units}
    for k in range(400):
        u = int(hashlib.md5(f"5:draw:{k}".encode()).hexdigest()[:13], 16) / 2**52
        assert got.get(k, 0) == poisson(rate[k % 4], u)
