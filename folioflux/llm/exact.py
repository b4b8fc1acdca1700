"""Exact duplicates by an extendible-hash index on shared files.

Every normalised text has a 64-bit hash. The directory maps the hash's leading bits to buckets:
it starts as one bucket, and a bucket with more entries than fit is split in two by its next bit,
which doubles the directory when the bucket already used all of the directory's bits. Each bucket
belongs to one owner task, which reads its entries in the order of the hash, chains those of
equal hash, and compares their bytes. The index is written to the shared folder bucket by bucket.

Copies meet before the shuffle: each map task passes on one entry for a text however often it
holds it, so a text that makes up a third of all rows loads its owner with one entry a map task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, by_all, free, fresh_dir, lookup_join, small_batches, trim, written

#: Entries (different texts) that a bucket holds before it is split, at least.
CAPACITY = 1024
#: A bucket's capacity grows with the number of texts so that there are about so many buckets at most:
#: the directory, which goes to every task, and the folders of the index are bounded by it.
MAX_BUCKETS = 1 << 15
#: Leading bits of the hash counted at once: first for all texts, then again for what is still too full.
STEP_BITS = 16

#: What a map task passes on for a text.
ENTRY = {"bucket": pa.int32(), "hash": pa.int64(), "sha": pa.string(), "norm": pa.string(), "keep_id": pa.int64(), "size": pa.int64()}
INDEXED = "bucket int, hash long, sha string, chain int, keep_id long, size long"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


class Directory:
    """The extendible hash's directory: 2 ** depth entries, each the number of a bucket.

    It starts as one entry and one bucket. Splitting a bucket that already uses all of the
    directory's bits doubles the directory. As a bucket's entries are neighbours, they are kept as
    runs: where each begins, so a deep directory costs no more than its buckets.
    """

    def __init__(self) -> None:
        self.depth = 0
        self.buckets = [(0, 0)]  # (leading bits, how many of them)

    def split(self, counts: dict[int, int], bits: int, capacity: int) -> list[int]:
        """Split buckets by counts of texts by the hash's leading `bits` bits; the buckets that need more bits.

        Buckets are split while too full and while the counts can tell their halves apart.
        """
        prefixes = np.array(sorted(counts), np.uint64)
        total = np.concatenate([[0], np.cumsum([counts[int(x)] for x in prefixes], dtype=np.int64)])
        queue, short = list(range(len(self.buckets))), []
        while queue:
            k = queue.pop()
            lead, used = self.buckets[k]
            span = bits - used
            if span < 0:
                continue
            low = np.searchsorted(prefixes, np.uint64(lead << span), "left")
            high = np.searchsorted(prefixes, np.uint64((lead + 1 << span) - 1), "right")
            if total[high] - total[low] <= capacity:
                continue
            if not span:
                short.append(k)
                continue
            self.depth = max(self.depth, used + 1)  # the directory doubles where the bucket used all of its bits
            self.buckets[k] = (lead * 2, used + 1)
            self.buckets.append((lead * 2 + 1, used + 1))
            queue += [k, len(self.buckets) - 1]
        return short

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first hash, bucket) of each run of entries, in the order of the hashes (unsigned)."""
        order = sorted(range(len(self.buckets)), key=lambda k: self.buckets[k][0] << (64 - self.buckets[k][1]))
        return np.array([self.buckets[k][0] << (64 - self.buckets[k][1]) for k in order], np.uint64), np.array(order)

    def entries(self) -> list[int]:
        """The directory written out: 2 ** depth bucket numbers."""
        out = [0] * (1 << self.depth)
        for k, (lead, used) in enumerate(self.buckets):
            wide = self.depth - used
            out[lead << wide : lead + 1 << wide] = [k] * (1 << wide)
        return out


def leading(hash_: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hash_, 64 - bits) if bits < 64 else hash_


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hash, sha): what identifies each row's normalised text. Map only."""
    norm = normalised(F.col(text))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), norm.alias("norm")).select(
        "doc_id", F.xxhash64("norm").alias("hash"), F.sha2("norm", 256).alias("sha")
    )


def _sorted_out(parts: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*parts)) or [()] * len(ENTRY)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ENTRY.values())], names=list(ENTRY))


def _gathered(batches: Iterator[pa.RecordBatch], runs: tuple[np.ndarray, np.ndarray], held_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Map side: (doc_id, hash, sha, norm) to entries, one for each different text held at once."""
    starts, owners = runs
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        ids, shas, norms = (batch.column(k).to_pylist() for k in (0, 2, 3))
        hashes = batch.column(1).to_numpy(zero_copy_only=False)
        buckets = owners[np.searchsorted(starts, hashes.view(np.uint64), "right") - 1]
        for doc_id, hash_, sha, norm, bucket in zip(ids, hashes.tolist(), shas, norms, buckets.tolist()):
            same = held.get(norm)
            if same is None:
                held[norm] = [bucket, hash_, sha, norm, doc_id, 1]
                size += len(norm) + 200
            else:
                same[5] += 1
                if doc_id is not None and (same[4] is None or doc_id < same[4]):
                    same[4] = doc_id
        if size >= held_bytes:
            yield _sorted_out(list(held.values()))
            held, size = {}, 0
    if held:
        yield _sorted_out(list(held.values()))
    held.clear()
    trim()


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's entries, sorted by bucket and hash, to its part of the index.

    Memory holds the different texts of one hash at a time: a single one but for collisions.
    """
    chain: list[list] = []
    ready: list[tuple] = []
    now = None

    def flushed() -> list[tuple]:
        if len({x[2] for x in chain}) < len(chain):
            raise ValueError("different texts with one SHA-256")
        return [(b, h, s, k, keep, size) for k, (b, h, s, _, keep, size) in enumerate(chain)]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "hash", "sha", "chain", "keep_id", "size"])

    for batch in batches:
        for entry in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if entry[1] != now:
                ready += flushed()
                chain, now = [], entry[1]
                if len(ready) >= 10_000:
                    yield out(ready)
                    ready = []
            same = next((x for x in chain if x[3] == entry[3]), None)  # compares the bytes
            if same is None:
                chain.append(list(entry))
            else:
                same[4] = min((x for x in (same[4], entry[4]) if x is not None), default=None)
                same[5] += entry[5]
    if ready := ready + flushed():
        yield out(ready)
    trim()


def directory_of(sigs: DataFrame, capacity: int = CAPACITY, step_bits: int = STEP_BITS) -> Directory:
    """The directory for a table of signatures.

    Texts are counted by the hash's leading bits: 2 ** step_bits numbers go to the driver, then as
    many for each 2 ** (step_bits / 2) buckets that are still too full, with more bits, until all
    fit or the hash has no more bits (then a bucket holds a single hash, and is chained). Buckets
    hold more than `capacity` only so that there are some MAX_BUCKETS at most.
    """
    hashes = written(sigs.select("hash").distinct(), f"{fresh_dir(sigs.sparkSession, 'exact')}/hashes")
    capacity = max(capacity, 4 * hashes.count() // MAX_BUCKETS)
    found, bits, full = Directory(), step_bits, None
    counted = lambda df, n: {r["prefix"] % (1 << 64): r["n"] for r in df.groupBy(leading(F.col("hash"), n).alias("prefix")).agg(F.count("*").alias("n")).collect()}
    full = found.split(counted(hashes, bits), bits, capacity)
    while full and bits < 64:
        at, bits = bits, min(64, bits + step_bits // 2)
        counts: dict[int, int] = {}
        for k in range(0, len(full), 1 << step_bits // 2):
            leads = [lead - (1 << 64) if at == 64 and lead >= 1 << 63 else lead for lead, _ in (found.buckets[x] for x in full[k : k + (1 << step_bits // 2)])]
            counts |= counted(hashes.filter(leading(F.col("hash"), at).isin(leads)), bits)
        full = found.split(counts, bits, capacity)
    return found


def build_index(docs: DataFrame, path: str, directory: Directory, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index below path, as a table: (hash, sha, chain, keep_id, size, bucket), a row for each text.

    keep_id is the least id of the rows with the text (nulls are passed over; null if all are
    null), size their number, chain the place among the texts of one hash. A bucket's rows are in
    the folder bucket=..., so a later batch reads only the buckets of its own hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(directory.runs())  # 16 bytes a bucket
    norm = normalised(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", F.xxhash64("norm").alias("hash"), F.sha2("norm", 256).alias("sha"), "norm")
    entries = rows.mapInArrow(lambda batches: _gathered(batches, shared.value), "bucket int, hash long, sha string, norm string, keep_id long, size long")
    owned = entries.repartition("bucket").sortWithinPartitions("bucket", "hash").mapInArrow(_owned, INDEXED)
    owned.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return spark.read.schema("hash long, sha string, chain int, keep_id long, size long, bucket int").parquet(path)


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha) for every row, dropped ones too.

    Texts are equal when their bytes are after white space is normalised; a null text counts as
    empty. Of equal texts the row with the least id stays; of rows that repeat this id and text
    one stays; null ids come last. Very long texts are compared whole. An empty table gives no
    rows; other columns are not read, whatever their names.
    """
    path = fresh_dir(docs.sparkSession, "exact")
    sigs = signatures(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    sigs = written(sigs, f"{path}/signatures")  # the numbers of rows are fixed from here on
    index = build_index(docs, f"{path}/index", directory_of(sigs), doc_id, text)
    # The first of the rows that have a text's keep_id: one row a text and id on the left, one a text on the right.
    firsts = sigs.groupBy("hash", "sha", F.col("doc_id").alias("keep_id")).agg(F.min("row").alias("keep_row"))
    same = (F.col("f.hash") == F.col("i.hash")) & (F.col("f.sha") == F.col("i.sha")) & F.col("f.keep_id").eqNullSafe(F.col("i.keep_id"))
    classes = index.alias("i").join(firsts.alias("f"), same).select("i.hash", "i.sha", "i.keep_id", "i.size", "keep_row")
    classes = written(classes, f"{path}/classes")
    found = lookup_join(sigs, classes, ["hash", "sha"], "size")
    return found.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "sha")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without exact duplicates: the rows that duplicates() keeps, whole.

    Of rows that share the text and the least id, the first by all columns stays. Empty and null
    texts are one text; an empty table stays empty; extra columns keep their names.
    """
    path = fresh_dir(docs.sparkSession, "exact")
    sigs = written(signatures(docs), f"{path}/signatures")
    index = build_index(docs, f"{path}/index", directory_of(sigs))
    sha, lacks, some, place = (free(c, docs.columns) for c in ("_sha", "_lacks", "_id", "_place"))
    no_id = F.lit(0)  # beside the flag `lacks`
    kept = index.select(F.col("sha").alias(sha), F.col("keep_id").isNull().alias(lacks), F.coalesce("keep_id", no_id).alias(some))
    keyed = docs.withColumns({sha: F.sha2(normalised(F.col("text")), 256), lacks: F.col("doc_id").isNull(), some: F.coalesce(F.col("doc_id").cast("long"), no_id)})
    key = [sha, lacks, some]
    one = F.row_number().over(Window.partitionBy(*key).orderBy(*by_all(docs)))  # cut to one a key before the shuffle
    return keyed.withColumn(place, one).filter(F.col(place) == 1).join(kept, key, "left_semi").select(*docs.columns)
