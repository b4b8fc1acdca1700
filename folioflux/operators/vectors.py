"""Embedding, and exact cosine search of many questions over many vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Questions that are broadcast at most, or that a task takes; and vectors that a task takes, about.
BLOCK = 4096
PART = 200_000

Embedder = Callable[[list[str]], np.ndarray]
EMBEDDERS: dict[str, Callable[[], Embedder]] = {}


def embedder(name: str) -> Callable[[Callable[[], Embedder]], Callable[[], Embedder]]:
    """Register a factory: it is called once in each Python worker, its result for each batch."""
    def register(factory: Callable[[], Embedder]) -> Callable[[], Embedder]:
        EMBEDDERS[name] = factory
        return factory
    return register


def hashed_words(dims: int = 64) -> Embedder:
    """A deterministic stand-in for a model: hashed word counts, unit length (zero for blank text)."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dims] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


embedder("hashed-words")(hashed_words)


def embed(df: DataFrame, text: str = "text", model: str = "hashed-words", into: str = "embedding") -> DataFrame:
    """df with a vector for each text; null counts as blank. The model is made once a worker."""
    ship(df.sparkSession)
    factory = EMBEDDERS[model]

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = factory()
        for batch in batches:
            yield pd.Series(list(run([x or "" for x in batch]).astype(np.float32)))

    return df.withColumn(into, vectors(F.col(text)))


def flow(stored: DataFrame, new: DataFrame, text: str = "chunk_text", model: str = "hashed-words") -> DataFrame:
    """All stored chunks with their vectors, or, if the store has none, all new ones (which are then
    to be stored). New chunks are left alone while the store has any."""
    return embed(new if stored.isEmpty() else stored, text, model)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns, in doubles, in the JVM."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay, and are similar to nothing."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest, the largest first; of equal ones the first columns."""
    if sims.shape[1] > 4 * k:
        near = np.sort(np.argpartition(-sims, k - 1, axis=1)[:, :k], axis=1)
        least = np.take_along_axis(sims, near, axis=1).min(axis=1, keepdims=True)
        for row in np.nonzero((sims >= least).sum(axis=1) > k)[0]:  # ties at the border
            near[row] = np.sort(np.argsort(-sims[row], kind="stable")[:k])
        order = np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable")
        return np.take_along_axis(near, order, axis=1)
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


def _nearest(q_ids: pa.Array, questions: pa.Array, ids: pa.Array, vectors: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest vectors of each question among those given, compared where the lengths are the same."""
    q_sizes, sizes = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (questions, vectors))
    by_id = pc.sort_indices(ids).to_numpy()  # so that ties fall to the smaller id
    for n in np.unique(q_sizes[q_sizes > 0]):
        at = by_id[sizes[by_id] == n]
        if not len(at):
            continue
        own = ids.take(pa.array(at))
        matrix = lambda lists, rows: _unit(lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n))  # noqa: B023, E731
        x, asking = matrix(vectors, at), np.nonzero(q_sizes == n)[0]
        for first in range(0, len(asking), 1024):
            rows = asking[first : first + 1024]
            sims = matrix(questions, rows) @ x.T
            best = _best(sims, k)
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(np.repeat(rows, best.shape[1]))), own.take(pa.array(best.ravel())), pa.array(np.take_along_axis(sims, best, axis=1).ravel())], names=["question_id", "vec_id", "similarity"])


def search(vectors: DataFrame, questions: DataFrame, k: int, vec: str = "vec_id", question: str = "question_id", embedding: str = "embedding") -> DataFrame:
    """(question_id, vec_id, similarity, rank): the k nearest vectors of each question, by cosine.

    Exact. Up to BLOCK questions are broadcast, and the vectors are passed over once. More are dealt
    into blocks, as the vectors are into parts, and each block meets each part in a task of its
    own; nothing but two counts goes to the driver. A task keeps its own k best a question, so what is
    shuffled after it is k rows a question and task, never all pairs. Ties go to the smaller id. Null
    vectors, and those with a null in them, are left out; a vector is compared with questions of
    its own length alone.
    """
    ship(vectors.sparkSession)
    usable = lambda df, id_, name: df.select(F.col(id_).alias(name), F.col(embedding).cast("array<double>").alias("v")).filter("v is not null and not exists(v, x -> x is null)")
    asked, rows = usable(questions, question, "question_id"), usable(vectors, vec, "vec_id")
    schema = f"question_id {asked.schema['question_id'].dataType.simpleString()}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, similarity double"
    held = asked.limit(BLOCK + 1).toArrow()
    if held.num_rows <= BLOCK:
        held = held.combine_chunks()
        shared = vectors.sparkSession.sparkContext.broadcast(held)  # BLOCK vectors at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            q_ids, q_v = (q.column(c).chunk(0) for c in (0, 1))
            for batch in batches:
                yield from _nearest(q_ids, q_v, batch.column(0), batch.column(1), k)

        found = rows.mapInArrow(run, schema) if held.num_rows else vectors.sparkSession.createDataFrame([], schema)
    else:
        n_blocks, n_parts = (max(1, -(-df.count() // size)) for df, size in ((asked, BLOCK), (rows, PART)))
        place = lambda df, name, n, other, m: df.withColumns({name: F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})

        def meet(q: pa.Table, x: pa.Table) -> pa.Table:
            columns = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in (*q.select(["question_id", "v"]).columns, *x.select(["vec_id", "v"]).columns)]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            parts = list(_nearest(*columns, k)) if q.num_rows and x.num_rows else []
            return pa.Table.from_batches(parts) if parts else pa.table({"question_id": columns[0].slice(0, 0), "vec_id": columns[2].slice(0, 0), "similarity": pa.array([], pa.float64())})

        left = place(asked, "block", n_blocks, "part", n_parts).groupBy("block", "part")
        found = left.cogroup(place(rows, "part", n_parts, "block", n_blocks).groupBy("block", "part")).applyInArrow(meet, schema)
    first = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", first).filter(F.col("rank") <= k)


def stats(vectors: DataFrame, size_mb: float | None = None, chunk_kib: int = 10) -> DataFrame:
    """One row: files, vectors, the size in MB, that expected at chunk_kib KiB a vector, and how many times that it is."""
    found = vectors.agg(F.countDistinct("filename").alias("n_files"), F.count("*").alias("n_vectors"))
    found = found.withColumn("size_mb", F.round(F.lit(size_mb).cast("double"), 2)).withColumn("expected_mb", F.round(F.col("n_vectors") * chunk_kib / F.lit(1024.0), 2))
    return found.withColumn("bloat", F.when(F.col("expected_mb") > 0, F.round(F.col("size_mb") / F.col("expected_mb"), 1)).otherwise(1.0))


def list_documents(vectors: DataFrame) -> DataFrame:
    """Files by name, from their vectors alone: a path, the number of chunks; when they were made isn't known."""
    found = vectors.groupBy("filename").agg(F.coalesce(F.min("path"), F.lit("")).alias("path"), F.count("*").alias("chunk_count"))
    return found.withColumn("created_at", F.lit("N/A")).orderBy("filename")


def batches(vectors: DataFrame, key: str, size: int, per_part: int = 100_000) -> DataFrame:
    """A batch number for writers that take at most `size` rows at a time, in the order of a numeric key.

    The key's range is cut at approximate quantiles, rows are numbered inside each part, and the
    numbers offset by the parts' counts; so no task sees all rows, and the cuts go to the driver.
    """
    n = vectors.count()
    shares = [i * per_part / n for i in range(1, -(-n // per_part))] if n else []
    cuts = vectors.agg(F.percentile_approx(key, [float(x) for x in shares], 10_000).alias("cuts")).first()["cuts"] if shares else []
    part = vectors.withColumn("_p", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast(f"array<{vectors.schema[key].dataType.simpleString()}>"), lambda c: c <= F.col(key))))
    counts = part.groupBy("_p").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    row = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    placed = part.withColumn("_r", row).join(F.broadcast(counts.select("_p", offset.alias("_before"))), "_p")
    return placed.withColumn("batch", F.floor((F.col("_before") + F.col("_r") - 1) / size).cast("int")).drop("_p", "_r", "_before")


def lsh_candidates(vectors: DataFrame, questions: DataFrame, planes: int = 12, tables: int = 8, seed: int = 7, vec: str = "vec_id", question: str = "question_id", embedding: str = "embedding") -> DataFrame:
    """(question_id, vec_id): pairs on the same side of `planes` random planes in one of `tables` tables, to be
    searched exactly. An option for tables too large to pass over: it finds near vectors with a chance that grows with
    planes and tables. Vectors of different lengths never meet."""
    ship(vectors.sparkSession)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[sizes > 0]):
                at = np.nonzero(sizes == n)[0]
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                sides = x @ np.random.default_rng([seed, int(n)]).normal(size=(n, planes * tables)) > 0
                keys = sides.reshape(len(at), tables, planes) @ (1 << np.arange(planes)) + (np.arange(tables) + int(n) * tables) * (1 << planes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, tables))), pa.array(keys.ravel().astype(np.int64))], names=["id", "key"])

    def keyed(df: DataFrame, id_: str, name: str) -> DataFrame:
        rows = df.select(F.col(id_).alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter("v is not null and not exists(v, x -> x is null)")
        return rows.mapInArrow(signatures, f"id {rows.schema['id'].dataType.simpleString()}, key long").withColumnRenamed("id", name)

    return keyed(questions, question, "question_id").join(keyed(vectors, vec, "vec_id"), "key").select("question_id", "vec_id").distinct()
