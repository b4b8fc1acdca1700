"""URL filters by a sort-merge range join over reversed-host keys, in DataFrame operations only.

A rule (host, path) fits its host, all subdomains, and the paths that start with its own. Its key
is the host's labels in reverse and the path; the keys that start with it are an interval, and
the intervals of a rule set nest like brackets. One sorted sweep over the intervals' ends keeps
the stack of open rules (simulated by their depth), and leaves at each end the rule on top after
it. A URL has a key for each of its host's suffixes; merged into the ends in sorted order, each
key takes the rule on top at the last end before it, which is the longest that fits.

URLs whose top-level label has no rule go round the sort. The others are dealt over salts by their
label's number of URLs, with the label's ends copied to each salt, so no host or label, however
common, has to sit in one task, nor a URL that is repeated very often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, written

#: URLs that a sort takes at once, about.
ROWS_A_SALT = 20_000
#: So many top-level labels are broadcast at most (some 40 bytes each).
MAX_LABELS = 10_000
#: Rules may differ in so many numbers of labels; a host name has 127 labels at most (RFC 1035).
MAX_LEVELS = 128

RULES = "host string, path string, verdict string"


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return _lowered(found)


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(labels: Column, suffix: int | Column, path_: Column) -> Column:
    """The last `suffix` labels in reverse, each closed by byte 0, then the path; as bytes.

    A byte 0 sorts before any other, so a host's own paths and its subdomains never interleave.
    """
    kept = F.reverse(F.slice(labels, -suffix if isinstance(suffix, int) else F.negate(suffix), suffix))
    return F.concat(F.array_join(kept, "."), F.lit("\x00"), path_).cast("binary")


def sweep(rules: DataFrame) -> DataFrame:
    """(label, level, key, top): the ends of the rules' intervals with the rule on top after each.

    rules: (host, path, verdict); rows with a null host or path, or an empty host, fit nothing. Of
    rows with the same host and path a block wins. level is the number of the host's labels: only
    rules of one level can nest, as a URL is looked up once for each of its host's suffixes.
    """
    clean = (
        rules.filter("host is not null and path is not null and host <> ''")
        .groupBy(_lowered(F.col("host")).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
        .withColumn("labels", F.split("host", r"\."))
        .withColumn("level", F.size("labels"))
        .withColumn("key", _key(F.col("labels"), F.col("level"), F.col("path")))
        .select(F.element_at("labels", -1).alias("label"), "level", "key", F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("rule"))
    )
    ends = clean.select("*", F.lit(1).alias("step")).unionByName(
        clean.select("label", "level", F.concat("key", F.expr("X'FF'")).alias("key"), "rule", F.lit(-1).alias("step"))
    )
    in_order = Window.partitionBy("label", "level").orderBy("key", "step")
    depth = F.sum("step").over(in_order)
    ends = ends.withColumn("depth", depth)  # after the end: how many rules are open
    # After a start its own rule is on top; after a stop, the rule that was put on the stack last
    # at the depth that is left.
    at_depth = Window.partitionBy("label", "level", "depth").orderBy("key", "step").rowsBetween(Window.unboundedPreceding, 0)
    below = F.last(F.when(F.col("step") == 1, F.col("rule")), ignorenulls=True).over(at_depth)
    top = F.when(F.col("step") == 1, F.col("rule")).when(F.col("depth") > 0, below)
    return ends.select("label", "level", "key", F.struct(top.alias("rule")).alias("top"))


def _labels(rows: DataFrame, ends: DataFrame, path_: str) -> tuple[DataFrame, bool]:
    """(label, ruled, salts) of top-level labels, MAX_LABELS at most; and whether all with rules are there.

    Where there are too many, the hottest are there, with and without rules; any other label then
    has no more URLs than the MAX_LABELS-th part of all.
    """
    counted = rows.groupBy("label").agg(F.count("*").alias("n"))  # summed before it is shuffled
    ruled = ends.select("label").distinct().withColumn("ruled", F.lit(True))
    known = written(counted.join(ruled, "label", "full").select("label", F.coalesce("ruled", F.lit(False)).alias("ruled"), F.coalesce("n", F.lit(0)).alias("n")), f"{path_}/labels")
    sums = known.agg(F.count_if("ruled").alias("ruled"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    whole = sums["ruled"] <= MAX_LABELS
    kept = known.filter("ruled") if whole else known.filter(F.col("n") > max(ROWS_A_SALT, sums["n"] // MAX_LABELS))
    return kept.select("label", "ruled", F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_A_SALT)).cast("int").alias("salts")), whole


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for every row.

    Longest rule wins (by the characters of host and path; on a tie, the longer host). rule is the
    winner's host and path, or null where none fits; verdict then is `default`. A null url or one
    without :// has an empty host and path, which no rule fits. Very long URLs are keyed whole.
    Repeated rows give a row each; other columns are not read, whatever their names; an empty table
    gives no rows. One shuffle of (page_id, url), and a sort for each level of rules; URLs whose
    top-level label has no rule are not shuffled. Rules of more than MAX_LEVELS different numbers
    of labels are refused.
    """
    at = fresh_dir(pages.sparkSession, "urls")
    ends = written(sweep(rules), f"{at}/ends")
    levels = [r["level"] for r in ends.select("level").distinct().orderBy("level").limit(MAX_LEVELS + 1).collect()]
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"rules of more than {MAX_LEVELS} different numbers of labels")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    rows = rows.withColumn("label", F.element_at(labels, -1))
    spread, whole = _labels(rows, ends, at)
    looked_up = rows.join(F.broadcast(spread), "label", "left")  # MAX_LABELS rows at most
    sorted_away = F.col("ruled") if whole else F.coalesce("ruled", F.lit(True))
    here = looked_up.filter(sorted_away)
    past = looked_up.filter(~F.coalesce(sorted_away, F.lit(False))).select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    here = here.withColumns({f"key_{n}": F.when(F.size(labels) >= n, _key(labels, n, F.col("path"))) for n in levels})
    # The partition's number tells repeats of one row apart, and is the same when a lost task is run again.
    salt = F.pmod(F.xxhash64("page_id", "url", F.spark_partition_id()), F.coalesce("salts", F.lit(1))).cast("int")
    here = here.withColumn("salt", salt).drop("salts", "ruled").withColumn("is_row", F.lit(True))
    marks = ends.join(F.broadcast(spread.select("label", "salts")), "label", "left").select("label", "level", "key", "top", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    for n in levels:
        marks = marks.withColumn(f"key_{n}", F.when(F.col("level") == n, F.col("key")))
    marks = marks.drop("key").withColumn("is_row", F.lit(False))
    merged = here.unionByName(marks, allowMissingColumns=True)
    for n in levels:
        in_order = Window.partitionBy("label", "salt").orderBy(F.col(f"key_{n}").asc_nulls_first(), "is_row").rowsBetween(Window.unboundedPreceding, 0)
        last = F.last(F.when(F.col("level") == n, F.col("top")), ignorenulls=True).over(in_order)
        merged = merged.withColumn(f"top_{n}", last["rule"])
    fits = [F.when(F.col(f"key_{n}").isNotNull() & F.col(f"top_{n}").isNotNull(), F.struct(F.length(f"top_{n}.rule").alias("size"), F.lit(n).alias("level"), F.col(f"top_{n}.rule").alias("rule"), F.col(f"top_{n}.verdict").alias("verdict"))) for n in levels]
    best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,level:int,rule:string,verdict:string>")
    judged = merged.filter("is_row").select("page_id", "url", "host", "path", best.alias("best")).select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
    return judged.unionByName(past)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of (host, path, verdict) from a list given in code."""
    return spark.createDataFrame(rules, RULES)
