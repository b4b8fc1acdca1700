"""SimHash near-duplicates: a grid over segment bit counts, then exact Hamming distances.

A 64-bit fingerprint becomes a vector of the bit counts of its segments. Changing one bit changes
one count by one, so the Manhattan distance of two vectors never exceeds the Hamming distance of
the fingerprints. The range join looks up cells of that space: the segments are dealt into
`groups` blocks, and fingerprints at most `radius` bits apart agree on all counts but those of
`radius` blocks; so for each choice of the blocks that may differ, the counts of the others are a
cell, and every pair to be found shares a cell. Candidates of a cell are compared by Manhattan
distance, then exactly.

Cells with more than `full` fingerprints (copies with small changes crowd into a few) are not
paired up. Their members meet in the middle instead: fingerprints two bits apart have a common
neighbour one bit from each, so each member is linked with the least one among those that share
a neighbour with it. That keeps every component, in rows proportional to the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_all, free, fresh_dir, lookup_join, small_batches, trim, written
from .components import components

SEED = 42
BITS = 64
#: Bits of a segment: two give counts 0, 1, 2, and 32 dimensions.
SEGMENT = 2
#: Cells of more fingerprints than this are not paired up.
FULL = 32

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
FINGERPRINTED = "doc_id long, fp long"


def fingerprint(text: str | None, width: int = 3, block: int = 1 << 13) -> int:
    """The unsigned fingerprint of a whole text; 0 without words.

    Words are runs without ASCII white space, A-Z lower-cased; a shingle is `width` words joined
    by a space, repeats counted (fewer words: all of them). A bit is 1 if it is set in over half
    of the shingles' XXH64. The shingles are hashed in blocks, so memory stays bounded.
    """
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = (sizes + 1).cumsum() - 1
    starts, stops = (ends - sizes)[:n].tolist(), (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, block):
        found = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + block], stops[at : at + block])], ">u8")
        counts += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: str | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row; and the column digest, if one
    is named. One pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            more = [batch.column(2)] if digest else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *more], names=["doc_id", "fp", "digest"][: 2 + len(more)])
        trim()

    more = [F.col(digest).alias("digest")] if digest else []
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)
    return read.mapInArrow(run, FINGERPRINTED + ", digest string" if digest else FINGERPRINTED)


def embedding(fp: Column) -> Column:
    """The vector of the segments' bit counts, packed in one long: two bits for each count."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed vectors of counts 0, 1, 2: unary codes 0, 1, 3, then bits that differ."""
    def unary(v: Column) -> Column:
        high = F.shiftrightunsigned(v, 1).bitwiseAND(F.lit(0x5555555555555555))
        return v.bitwiseOR(high)

    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def groups_for(n: int, radius: int) -> int:
    """Blocks of the grid: more blocks make finer cells, and more of them for each fingerprint.

    Chosen so that fingerprints spread at random (1.5 bits a segment) give fewer candidates than
    there are fingerprints. Any number of blocks finds the same links.
    """
    for groups in range(radius + 2, 17):
        cells = len(list(combinations(range(groups), radius)))
        if cells * n / 2 ** (1.5 * BITS / SEGMENT * (groups - radius) / groups) < 1:
            return groups
    return 16


def cells(distinct: DataFrame, groups: int, radius: int) -> DataFrame:
    """(fp, choice, cell): the grid cells of each fingerprint, one for each choice of free blocks."""
    segments = BITS // SEGMENT
    block = [sum(((1 << SEGMENT) - 1) << (SEGMENT * s) for s in range(segments) if s * groups // segments == g) for g in range(groups)]
    masks = []
    for free in combinations(range(groups), radius):
        kept = sum(m for g, m in enumerate(block) if g not in free)
        masks.append(kept - (1 << 64) if kept >= 1 << 63 else kept)
    packed = embedding(F.col("fp"))
    each = F.array(*[F.struct(F.lit(k).alias("choice"), packed.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)])
    return distinct.select("fp", F.inline(each))


def links(distinct: DataFrame, path: str, n: int, radius: int = 2, full: int = FULL) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) that make the same components as all
    pairs at most `radius` bits apart. radius is 1 or 2.

    Cells of up to `full` fingerprints give exactly their pairs; the members of fuller ones are
    linked through common neighbours. Nothing is dropped either way.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    grid = cells(distinct, groups_for(n, radius), radius)
    crowd = written(
        grid.groupBy("choice", "cell").agg(F.count("*").alias("size")).filter("size > 1"), f"{path}/cells"
    )
    small = crowd.filter(F.col("size") <= full).select("choice", "cell")
    large = crowd.filter(F.col("size") > full).select("choice", "cell")
    members = grid.join(small, ["choice", "cell"])
    packed = members.groupBy("choice", "cell").agg(F.array_sort(F.collect_set("fp")).alias("fps"))  # `full` at most
    one = packed.select("fps", F.posexplode("fps").alias("at", "a"))
    pairs = one.select("a", F.explode(F.expr("slice(fps, at + 2, size(fps))")).alias("b"))
    near = (manhattan(embedding(F.col("a")), embedding(F.col("b"))) <= radius) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    exact = pairs.filter(near).select("a", "b")

    crowded = grid.join(large, ["choice", "cell"]).select("fp").distinct()
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    around = crowded.select("fp", F.explode(ball).alias("middle"))
    if radius == 1:  # only the neighbour that is a fingerprint itself counts
        around = around.join(crowded.select(F.col("fp").alias("middle")), "middle")
    star = around.groupBy("middle").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n"))
    met = around.join(star.filter("a <> b"), "middle").select("a", F.col("fp").alias("b")).filter("a <> b")
    return exact.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the least doc_id reachable.

    Equal fingerprints are one node of the graph, so copies cost nothing beyond their own row. A
    null or empty text has fingerprint zero and links like any other; a very long one is
    fingerprinted in blocks. Rows without an id are compared like the rest; where a component has
    no id at all, component_id is null. Repeated rows give a row each; other columns are not read,
    whatever their names. An empty table gives no rows.
    """
    path = fresh_dir(docs.sparkSession, "simhash")
    rows = written(fingerprints(docs, doc_id, text), f"{path}/fingerprints")
    linked = _linked(rows, F.col("doc_id"), path, radius)
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(linked.join(least, "root").select("fp", "n_rows", "component_id"), f"{path}/classes")
    return lookup_join(rows, classes, ["fp"], "n_rows").select("doc_id", "fp", "component_id")


def _linked(rows: DataFrame, first: Column, path: str, radius: int) -> DataFrame:
    """(fp, n_rows, first, root) of the fingerprints of rows: the least value of `first` among each one's rows, and its component."""
    nodes = written(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n_rows")), f"{path}/nodes")
    found = links(nodes.select("fp"), path, nodes.count(), radius)
    roots = components(found, path)
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def one_of_each(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The documents (doc_id, text, ...) but for near-duplicates: of each component exactly one row stays.

    It is the row with the least doc_id; rows without an id come after all others, so one stays only
    where its component has none with an id. Of a component's rows that share this id, or lack one,
    the first by its text's SHA-256 stays, and of rows with one id and text the first by all other
    columns. A null text counts as empty. Rows are told apart by id and text, so rows that share
    an id but not a component never stand for one another. Extra columns keep their names.
    """
    path = fresh_dir(docs.sparkSession, "simhash")
    digest, lacks, some, place = (free(c, docs.columns) for c in ("_digest", "_lacks", "_id", "_place"))
    keyed = docs.withColumns({digest: F.sha2(F.coalesce("text", F.lit("")), 256), lacks: F.col("doc_id").isNull(), some: F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    rows = written(fingerprints(keyed, digest=digest), f"{path}/fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("lacks"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")
    # One row a fingerprint, then one a component: both minima are summed up before they are shuffled.
    chosen = _linked(rows, first, path, radius).groupBy("root").agg(F.min("first").alias("first"))
    chosen = written(chosen.select(F.col("first.lacks").alias(lacks), F.col("first.id").alias(some), F.col("first.digest").alias(digest)), f"{path}/chosen")
    key = [lacks, some, digest]
    one = F.row_number().over(Window.partitionBy(*key).orderBy(*by_all(docs)))  # cut to one a key before the shuffle
    return keyed.withColumn(place, one).filter(F.col(place) == 1).join(chosen, key, "left_semi").select(*docs.columns)
