"""Streams: files into the document store in small batches, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Settings
from ..operators.store import Store, new
from ..plans.engine import store_batch
from ..sources.files import parse, process

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str, pattern: str = "*.txt", parser: str = "text", s: Settings = DEFAULT, embedder: str = "hashed-words") -> StreamingQuery:
    """Read new files of a folder, file_batch at a time, into the store, with their vectors; ends when none is left.

    A batch is one commit, and files that the store has are passed over, so a batch that is run
    again after a failure is harmless. What is written is in proportion to the batch.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", s.file_batch).load(folder)

    def put(batch: DataFrame, _: int) -> None:
        named = new(store.documents(), batch.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content"))
        done = process(parse(named, parser), s).select("filename", "path", "doc_number", "chunks").persist()
        if not done.isEmpty():
            store_batch(store, done, embedder)
        done.unpersist()

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict[str, object]]:
    """What each batch of a query has done so far: its number, rows, and seconds."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["durationMs"].get("triggerExecution", 0) / 1000} for p in query.recentProgress]


def unique(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeated keys, as far back as `late`."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str = "ts", size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; works on streams and on tables.

    late=None is for a stream that has its watermark already (as from unique()).
    """
    events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events
    return events.groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total")
