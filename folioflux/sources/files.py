"""Files in and out: directories of documents, and the JSON exchange format."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import document_number
from ..operators.chunking import processed
from ..session import ship

PROCESSED = "filename string, path string, clean_text string, chunks array<string>, chunk_count int, doc_number string"
#: Parsers by name: a factory called once a worker, giving a function from a file's bytes to its text.
PARSERS: dict[str, Callable[[], Callable[[bytes], str]]] = {"text": lambda: lambda data: data.decode("utf-8", "replace")}


def scan(spark: SparkSession, *paths: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, filename, length, content) of the files of directories, not of what lies below them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def parse(files: DataFrame, parser: str = "text") -> DataFrame:
    """(path, filename, raw_text); a file that can't be parsed gives an empty text."""
    ship(files.sparkSession)
    factory = PARSERS[parser]

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = factory()

        def one(data: bytes | None) -> str:
            try:
                return run(data) if data is not None else ""
            except Exception:
                return ""

        for batch in batches:
            yield batch.map(one)

    return files.select("path", "filename", texts("content").alias("raw_text"))


def process(raw: DataFrame, s: Settings = DEFAULT, compat: bool = False) -> DataFrame:
    """(path, filename, raw_text) to processed documents; those without chunks are left out. No shuffle.

    Texts are cleaned once; compat cleans them twice.
    """
    rows = raw.select("filename", "path", "raw_text", processed(F.col("raw_text"), s, compat).alias("_done"))
    rows = rows.select("filename", "path", "raw_text", "_done.clean_text", "_done.chunks").filter(F.size("chunks") > 0)
    number = document_number(F.col("filename"), None, F.substring(F.col("clean_text"), 1, s.first_page_chars))
    return rows.select("filename", "path", "raw_text", "clean_text", "chunks", F.size("chunks").alias("chunk_count"), number.alias("doc_number"))


def write_json(documents: DataFrame, path: str, keep_clean: bool = False) -> None:
    """Processed documents as JSON lines, without raw text (and clean text, unless kept)."""
    documents.drop("raw_text", *([] if keep_clean else ["clean_text"])).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Processed documents from JSON: lines, or one array a file with multi_line."""
    return spark.read.schema(PROCESSED).option("multiLine", multi_line).json(path)
