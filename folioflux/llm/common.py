"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: ASCII white space as the contracts define it: space and \x09-\x0D.
WHITE = "[\\x20\\x09-\\x0D]+"
#: Keys held by more rows than this go to the broadcast side of lookup_join().
HOT_ROWS = 1000
#: At most this many hot keys are broadcast.
HOT_KEYS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master may go without the setting (as in tests); it then gets a temporary
    folder that ends with the process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="folioflux-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", f"file://{path}")
        path = f"file://{path}"
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(name: str, taken: list[str]) -> str:
    """name, with underscores in front until no column has it (in any case)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def by_all(docs: DataFrame, *but: str) -> list[Column]:
    """An order of rows by all columns but some, whatever their types: rows it ties are equal."""
    return [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes if c not in but]


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound what a Python worker holds at once; very long texts then come in few-row batches. The
    workers also get this package, if they lack it."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def trim() -> None:
    """Give memory that a Python worker no longer uses back: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def lookup_join(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """rows inner-joined with classes (unique by keys, with a column of how many of the rows hold them).

    Keys with more than T rows are joined by broadcast, the others by a shuffle in which no key
    has more than T rows. T is n / hot_keys, HOT_ROWS at least, and the sizes add up to n, so no
    more than hot_keys keys can be hot: the broadcast is bounded whatever the data. Both inputs
    should be written tables, as each is read twice.
    """
    n = rows.count()
    hot_over = max(HOT_ROWS, n // hot_keys)
    hot = classes.filter(F.col(size) > hot_over)
    rest = classes.filter(F.coalesce(F.col(size), F.lit(0)) <= hot_over)
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    return (
        marked.filter("_hot").drop("_hot").join(F.broadcast(hot), keys)
        .unionByName(marked.filter("_hot is null").drop("_hot").join(rest, keys))
    )


__all__ = ["HOT_KEYS", "HOT_ROWS", "WHITE", "by_all", "free", "fresh_dir", "held_out", "lookup_join", "shared_dir", "small_batches", "table", "trim", "written"]
