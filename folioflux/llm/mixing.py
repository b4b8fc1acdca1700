"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times its documents are repeated so that its share of the
text becomes its share of the weights. Each document draws a uniform number from a hash of the
seed and its id, inverts the Poisson distribution of its source's rate at it, and is emitted that
many times; a hash of seed, id and copy then deals the copies out over the whole result.

Up to LARGE_RATE the distribution is summed step by step and looked up. Beyond it the quantile comes
from its Cornish-Fisher expansion, which is off by one at most, for few draws; so neither time nor
memory grows with the rate. A document of very many copies is dealt out in blocks over the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, fresh_dir, lookup_join, written

#: The distributions are broadcast up to so many sources and steps in all (8 bytes each); beyond
#: that only those of so many hot sources are.
MAX_SOURCES = 10_000
MAX_STEPS = 1_000_000
HOT_SOURCES = 200
#: The largest rate whose distribution is written out.
LARGE_RATE = 10_000.0
#: Copies that a task emits of one document at a time; documents with more are dealt out first.
BLOCK = 100_000
#: Acklam's rational approximation of the normal quantile, central part and tails.
CENTRE = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_BY = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_BY = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL_FROM = 0.02425


def uniform(seed: int, purpose: str, *keys: Column) -> Column:
    """52 bits from an MD5 of the seed, the purpose and the keys, as a long."""
    text = F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """A key for a source that tells null from any text."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def rates(docs: DataFrame, weights: dict[str, float], default: float = 1.0, scale: float = 1.0) -> DataFrame:
    """(_key, rate): the mean repetitions of each source's documents.

    weights: the sources' target weights, `default` for the others and for a null source; they
    are shared out over the sources that are there. Size is counted in characters. scale: the
    result's size as a multiple of the input's. A source without any text has rate 0.
    """
    weight: Column = F.lit(float(default))
    for source, w in weights.items():
        weight = F.when(F.col("_key") == "1" + source, F.lit(float(w))).otherwise(weight)
    sizes = docs.groupBy(_key(F.col("source")).alias("_key")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("units"))
    sizes = written(sizes.withColumn("weight", weight), f"{fresh_dir(docs.sparkSession, 'mixing')}/sizes")
    total = sizes.filter("units > 0").agg(F.sum("units").alias("units"), F.sum("weight").alias("weights")).first()
    a_unit = float(scale) * float(total["units"] or 0) / float(total["weights"] or 1)
    return sizes.select("_key", F.when(F.col("units") > 0, F.lit(a_unit) * F.col("weight") / F.col("units")).otherwise(0.0).alias("rate"))


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(c)
    return out


def normal_quantile(u: Column) -> Column:
    """The standard normal quantile of u in [0, 1); 0 counts as the least uniform number."""
    u = F.greatest(u, F.lit(2.0**-53))
    far = F.sqrt(-2 * F.ln(F.least(u, 1 - u)))
    tail = _polynomial(TAIL, far) / _polynomial(TAIL_BY, far)
    off = u - 0.5
    centre = off * _polynomial(CENTRE, off * off) / _polynomial(CENTRE_BY, off * off)
    return F.when(u < TAIL_FROM, tail).when(u > 1 - TAIL_FROM, -tail).otherwise(centre)


def large_quantile(rate: Column, u: Column) -> Column:
    """The Poisson quantile of a large rate, by the Cornish-Fisher expansion, as a long."""
    z = normal_quantile(u)
    return F.greatest(F.ceil(rate + F.sqrt(rate) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * F.sqrt(rate)) - 0.5), F.lit(0)).cast("long")


def distributions(of: DataFrame) -> DataFrame:
    """(_key, rate, cdf): Poisson cumulative probabilities, up to where a double no longer grows.

    Rates over LARGE_RATE have an empty cdf.
    """
    large = of.filter(F.col("rate") > LARGE_RATE).select("_key", "rate", F.array().cast("array<double>").alias("cdf"))
    of = of.filter(F.col("rate") <= LARGE_RATE)
    steps = of.select("_key", "rate", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int"))).alias("k"))
    so_far = Window.partitionBy("_key").orderBy("k")
    log_p = F.col("k") * F.ln("rate") - F.col("rate") - F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(so_far)
    p = F.when(F.col("rate") > 0, F.exp(log_p)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    steps = steps.withColumn("p", p).withColumn("cdf", F.sum("p").over(so_far))
    return steps.groupBy("_key", "rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("cdf")).unionByName(large)


def _copied(rows: DataFrame, spread: bool) -> DataFrame:
    """A row for each copy, numbered from 0. spread: blocks of copies go to tasks of their own first."""
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / BLOCK))))
    if spread:
        blocks = blocks.repartition("u", "block")
    in_block = F.least(F.col("copies") - F.col("block") * BLOCK, F.lit(BLOCK)) - 1
    each = blocks.select("row", "rate", "copies", "block", F.explode(F.sequence(F.lit(0), in_block.cast("int"))).alias("at"))
    return each.select("row", "rate", "copies", (F.col("block") * BLOCK + F.col("at")).alias("copy"))


def mix(docs: DataFrame, weights: dict[str, float], default: float = 1.0, seed: int = 17, scale: float = 1.0) -> DataFrame:
    """The documents repeated by their draws and shuffled: all columns, then _copy (0-based),
    _copies, _rate and _key_shuffle; within each partition in the order of _key_shuffle. Where the
    documents have a column of such a name, the new one gets another underscore in front.

    A document's draw depends on the seed and its id alone, so any run and any cluster give the
    same copies; rows that repeat an id (a null one too) draw alike, and each is copied. Null and
    empty texts count no characters, very long ones all of theirs; an empty table gives no rows. Ties
    of _key_shuffle go by doc_id and copy. Memory: a source's distribution (some ten thousand steps at
    most), not its documents. One pass for the sizes, one with a single shuffle by a random key: no
    source, however large, meets in one task.
    """
    known = written(distributions(rates(docs, weights, default, scale)), f"{fresh_dir(docs.sparkSession, 'mixing')}/distributions")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("cdf") + 1), F.lit(0)).alias("steps"), F.max("rate").alias("rate")).first()
    copy, copies, rate, order = (free(c, docs.columns) for c in ("_copy", "_copies", "_rate", "_key_shuffle"))
    drawn = F.when(F.size("cdf") > 0, F.size(F.filter("cdf", lambda c: c <= F.col("u"))).cast("long")).otherwise(large_quantile(F.col("rate"), F.col("u")))
    packed = docs.select(F.struct(*docs.columns).alias("row"), _key(F.col("source")).alias("_key"), (uniform(seed, "draw", F.col("doc_id")) / F.lit(float(1 << 52))).alias("u"))
    if size["n"] <= MAX_SOURCES and size["steps"] <= MAX_STEPS:
        found = packed.join(F.broadcast(known), "_key")
    else:
        held = docs.groupBy(_key(F.col("source")).alias("_key")).agg(F.count("*").alias("_n"))
        found = lookup_join(packed, known.join(held, "_key"), ["_key"], "_n", HOT_SOURCES)
    rows = found.select("row", "rate", "u", drawn.alias("copies")).filter("copies > 0")
    if (size["rate"] or 0) * 2 > BLOCK:
        each = _copied(rows.filter(F.col("copies") <= BLOCK), False).unionByName(_copied(rows.filter(F.col("copies") > BLOCK), True))
    else:
        each = rows.select("row", "rate", "copies", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
    keyed = each.select("row.*", F.col("copy").cast("long").alias(copy), F.col("copies").alias(copies), F.col("rate").alias(rate), uniform(seed, "order", F.col("row.doc_id"), F.col("copy")).alias(order))
    return keyed.repartition(order).sortWithinPartitions(order, "doc_id", copy)
