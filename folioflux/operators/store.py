"""The document store: documents and chunks as tables, with keys instead of row numbers.

documents: (filename, path, doc_number, created_at), key (filename, path)
chunks:    (chunk_id, filename, path, chunk_index, chunk_text, created_at), keys chunk_id and
           (filename, path, chunk_index)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id
from ..sources.commits import Log, Raced

DOC_KEY = ["filename", "path"]


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col("path"), F.col("filename"), F.col("chunk_index")))


def add_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore: of new rows with one key the first by document number is taken; old rows stay."""
    first = F.row_number().over(Window.partitionBy(*DOC_KEY).orderBy(F.col("doc_number").asc_nulls_last()))
    fresh = new.withColumn("_n", first).filter("_n = 1").drop("_n").join(old.select(*DOC_KEY), DOC_KEY, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def put_chunks(old: DataFrame, new: DataFrame, order: str = "chunk_text") -> DataFrame:
    """Insert or replace: new rows win over old ones with the same document and index.

    chunk_id is a function of the document and the index, so one key serves both constraints. Of
    new rows with one key the last by `order` wins.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*DOC_KEY, "chunk_index").orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_n", last).filter("_n = 1").drop("_n", "_new")


def all_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk with its document, in the order of file name and index."""
    own = chunks.select("chunk_id", *DOC_KEY, "chunk_index", "chunk_text")
    joined = own.join(documents.select(*DOC_KEY, "doc_number"), DOC_KEY)
    return joined.select("chunk_id", *DOC_KEY, "doc_number", "chunk_index", "chunk_text").orderBy("filename", "path", "chunk_index")


def chunks_by_ids(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks whose id is in ids (chunk_id)."""
    return all_chunks(documents, chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi"))


def list_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document, when it was added, and its number of chunks, 0 for none; in the order of the
    names. Chunks are counted before the join."""
    counts = chunks.groupBy(*DOC_KEY).agg(F.count("*").alias("n"))
    made = F.col("created_at") if "created_at" in documents.columns else F.lit(None).cast("timestamp").alias("created_at")
    found = documents.join(counts, DOC_KEY, "left").select("filename", "path", "doc_number", made, F.coalesce("n", F.lit(0)).alias("chunk_count"))
    return found.orderBy("filename", "path")


def existing(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose file the store has already; by file name and path."""
    return candidates.join(documents.select(*DOC_KEY), DOC_KEY, "left_semi")


def new(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    return candidates.join(documents.select(*DOC_KEY), DOC_KEY, "left_anti")


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: how many documents and chunks."""
    one = documents.agg(F.count("*").alias("n")).select(F.lit("documents").alias("what"), "n")
    two = chunks.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("what"), "n")
    return one.unionByName(two)


class Store:
    """Documents, chunks and vectors as Parquet below a folder, under one log of versions.

    Every write adds a batch: a folder for each table, written aside, then named by one commit for
    all three; so a writer that dies leaves nothing that is read, and the next one starts clean.
    What is written is in proportion to the batch. Rows that a batch replaces are named in a
    folder of their own, and left out when older batches are read.
    """

    DOCUMENTS = "filename string, path string, doc_number string, created_at timestamp"
    CHUNKS = "chunk_id string, filename string, path string, chunk_index int, chunk_text string, created_at timestamp"
    VECTORS = "chunk_id string, filename string, path string, chunk_index int, embedding array<float>, collection string"
    CHUNK_KEY = [*DOC_KEY, "chunk_index"]
    TABLES = ["documents", "chunks", "vectors", "gone"]

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)

    def _at(self, table: str, batch: str) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def _drop(self, batch: str) -> None:
        for table in self.TABLES:
            self.log.fs().delete(self.log.path(f"{table}/batch={batch}"), True)

    def _table(self, name: str, schema: str, batches: list[dict]) -> DataFrame:
        """The rows of a table that no later batch replaces."""
        found, gone = self.spark.createDataFrame([], schema), None
        groups: list[tuple[list[str], DataFrame | None]] = []
        for batch in reversed(batches):  # batches between two replacements are read together
            if name in batch["tables"]:
                if not groups or groups[-1][1] is not gone:
                    groups.append(([], gone))
                groups[-1][0].append(self._at(name, batch["id"]))
            if name != "documents" and "gone" in batch["tables"]:
                more = self.spark.read.schema("filename string, path string, chunk_index int").parquet(self._at("gone", batch["id"]))
                gone = more if gone is None else gone.unionByName(more)
        for paths, without in groups:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*found.columns)
            found = found.unionByName(rows if without is None else rows.join(without.distinct(), self.CHUNK_KEY, "left_anti").select(*found.columns))
        return found

    def _now(self) -> list[dict]:
        return self.log.read(self.log.version())

    def documents(self) -> DataFrame:
        return self._table("documents", self.DOCUMENTS, self._now())

    def chunks(self) -> DataFrame:
        return self._table("chunks", self.CHUNKS, self._now())

    def vectors(self, collection: str | None = None) -> DataFrame:
        """The vectors, of all collections or of one; a collection is a folder of its own."""
        found = self._table("vectors", self.VECTORS, self._now())
        return found if collection is None else found.filter(F.col("collection") == collection)

    def save(self, documents: DataFrame, chunks: DataFrame, replace: bool = False, vectors: DataFrame | None = None) -> None:
        """Add documents (insert or ignore), chunks (insert or replace) and their vectors (chunk_id,
        filename, path, chunk_index, embedding, collection); replace=True drops what was there."""
        now = F.current_timestamp()
        docs = documents.select("filename", "path", "doc_number", now.alias("created_at"))
        rows = with_chunk_ids(chunks).select("chunk_id", "filename", "path", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text", now.alias("created_at"))
        while True:
            version = self.log.version()
            held = [] if replace else self.log.read(version)
            name, tables = uuid.uuid4().hex, ["documents", "chunks"]
            known = self._table("documents", self.DOCUMENTS, held)
            add_documents(known, docs).join(known.select(*DOC_KEY), DOC_KEY, "left_anti").select(*known.columns).write.parquet(self._at("documents", name))
            put_chunks(rows.limit(0), rows).select(*rows.columns).write.parquet(self._at("chunks", name))
            if vectors is not None:
                vectors.select("chunk_id", "filename", "path", "chunk_index", "embedding", "collection").write.partitionBy("collection").parquet(self._at("vectors", name))
                tables += ["vectors"] if self.log.size(f"vectors/batch={name}") else []
            if held:
                written = self.spark.read.schema(self.CHUNKS).parquet(self._at("chunks", name)).select(*self.CHUNK_KEY)
                again = written.join(self._table("chunks", self.CHUNKS, held).select(*self.CHUNK_KEY), self.CHUNK_KEY, "left_semi")
                if not again.isEmpty():
                    again.write.parquet(self._at("gone", name))
                    tables.append("gone")
            try:
                return self.log.commit([*held, {"id": name, "tables": tables}], version + 1)
            except Raced:  # what is known has changed: begin again
                self._drop(name)

    def compact(self) -> None:
        """All batches as one, in a new version."""
        version = self.log.version()
        held, name = self.log.read(version), uuid.uuid4().hex
        if len(held) < 2:
            return
        tables = []
        for table, schema in (("documents", self.DOCUMENTS), ("chunks", self.CHUNKS), ("vectors", self.VECTORS)):
            if any(table in batch["tables"] for batch in held):
                out = self._table(table, schema, held).write
                (out.partitionBy("collection") if table == "vectors" else out).parquet(self._at(table, name))
                tables.append(table)
        self.log.commit([{"id": name, "tables": tables}], version + 1)

    def vacuum(self, keep_seconds: float = 7 * 24 * 3600) -> None:
        """Delete versions older than keep_seconds but the newest, and batches as old that no version left names."""
        fs, newest = self.log.fs(), self.log.version()
        for name, age in self.log.entries("commits"):
            if age > keep_seconds and name != f"v{newest:012d}":
                fs.delete(self.log.path(f"commits/{name}"), False)
        left = {batch["id"] for name, _ in self.log.entries("commits") if name.startswith("v") for batch in self.log.read(int(name[1:]))}
        for name, age in {x for table in self.TABLES for x in self.log.entries(table)}:
            if age > keep_seconds and name.removeprefix("batch=") not in left:
                self._drop(name.removeprefix("batch="))

    def stats(self) -> dict[str, object]:
        """Documents, chunks, the size in MB, and where the store is."""
        size = sum(self.log.size(f"{table}/batch={batch['id']}") for batch in self._now() for table in batch["tables"])
        return {"documents": self.documents().count(), "chunks": self.chunks().count(), "size_mb": round(size / 2**20, 2), "path": self.root}

    def is_ready(self) -> bool:
        """Whether anything can be asked."""
        return not self.chunks().isEmpty()
