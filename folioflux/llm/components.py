"""Connected components of a graph held in tables, by alternating stars."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(ends: DataFrame) -> DataFrame:
    """(k, m): the least neighbour m of each node u; k is u again, as the key to join by.

    Adaptive execution splits a join's skewed partitions only where both sides come straight from
    a shuffle. k is computed, so the aggregate's partitions by u don't serve the join, and it does.
    """
    return ends.groupBy("u").agg(F.min("v").alias("m")).select(F.shiftright("u", 0).alias("k"), "u", "m")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each edge's larger end (large) or smaller ends (small) linked to the least node around.

    The minimum is summed up before it is shuffled, and the join that brings it back to the edges is
    one that adaptive execution may split, so a node with very many links doesn't sit in one task.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:  # both directions; link every larger neighbour to the least of the neighbourhood
        ends = ends.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = _least(ends).select("k", F.least("u", "m").alias("m"))
        out = ends.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:  # from the larger end to its smaller neighbours, itself included
        ends = ends.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = _least(ends)
        out = ends.join(least.select("k", "m"), F.col("u") == F.col("k")).select(F.col("v").alias("b"), F.col("m").alias("a"))
        out = out.unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return out.filter("a <> b").select("a", "b").distinct()


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, root): every node that has an edge, with the least node of its component.

    edges: (a, b) longs, in any direction, repeats and loops allowed. Every round is written below
    path, which cuts the lineage; the rounds end when the edges are stars that no longer change
    (their number grows with the logarithm of the nodes, and has no limit). Nothing but two sums
    goes to the driver.
    """
    now = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{path}/edges-0")
    state = None
    for k in count(1):
        now = written(_stars(_stars(now, large=True), large=False), f"{path}/edges-{k}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return written(roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), f"{path}/components")
