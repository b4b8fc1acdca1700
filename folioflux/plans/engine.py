"""The engine: ingest, retrieve, answer, for whole tables of documents and questions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, LLM_MODELS, UNKNOWN_MODEL, Settings
from ..operators import chunking, context, ranking, store, vectors
from ..sources import files


def model_config(model: str) -> dict[str, object]:
    """An answer model's catalog row; defaults for unknown names."""
    names = ("tier", "max_tokens", "temperature", "top_p", "prompt_style", "context_window")
    return dict(zip(names, next((row[1:] for row in LLM_MODELS if row[0] == model), UNKNOWN_MODEL)))


@dataclass
class Engine:
    spark: SparkSession
    root: str
    settings: Settings = DEFAULT
    embedder: str = "hashed-words"
    model: str = LLM_MODELS[1][0]
    store: store.Store = field(init=False)

    def __post_init__(self) -> None:
        self.settings.checked()
        self.store = store.Store(self.spark, f"{self.root}/store")

    def ingest(self, raw: DataFrame, replace: bool = False) -> DataFrame:
        """(path, filename, raw_text) into the store, vectors included; a row of counts comes back.

        Files that the store has already (by name and path) are passed over unless replace is set.
        Documents, chunks and vectors are committed together, so a run that dies changes nothing.
        """
        todo = raw if replace else store.new(self.store.documents(), raw)
        done = files.process(todo, self.settings).persist()
        store_batch(self.store, done, self.embedder, replace)
        counts = todo.agg(F.count("*").alias("total")).crossJoin(F.broadcast(done.agg(F.count("*").alias("ok"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))))
        found = self.spark.createDataFrame(counts.collect(), counts.schema).withColumn("failed", F.col("total") - F.col("ok"))
        done.unpersist()
        return found

    def is_ready(self) -> bool:
        return self.store.is_ready()

    def has_generator(self, name: str) -> bool:
        return name in context.GENERATORS

    def stats(self) -> dict[str, object]:
        """The store's documents, chunks, size and path, and the vectors of this engine's collection."""
        return self.store.stats() | {"collection": collection(self.embedder), "vectors": self.store.vectors(collection(self.embedder)).count()}

    def list_documents(self) -> DataFrame:
        return store.list_documents(self.store.documents(), self.store.chunks())

    def retrieve(self, questions: DataFrame, k: int | None = None, rerank: bool = False) -> DataFrame:
        """Hits for (question_id, question): top k by cosine, ranked by document; optionally scored again."""
        s = self.settings
        k = k or s.retrieve_k
        wide = max(k, s.rerank_top) if rerank else k
        table = self.store.vectors(collection(self.embedder))
        asked = vectors.embed(questions, "question", self.embedder)
        hits = vectors.search(table, asked, wide, vec="chunk_id").withColumnRenamed("vec_id", "chunk_id")
        meta = table.select("chunk_id", "filename", "path", "chunk_index")
        joined = hits.join(meta, "chunk_id").join(self.store.documents().select("filename", "path", "doc_number"), ["filename", "path"], "left")
        texts = context.with_text(joined, self.store.chunks()).join(questions, "question_id")
        ranked = ranking.by_document(texts, s)
        if rerank:
            ranked = ranking.rerank(ranked, s)
        return ranked.filter(F.col("rank") <= k)

    def answer(self, questions: DataFrame, k: int | None = None, rerank: bool = False, generator: str | None = None, use_context: bool = True) -> DataFrame:
        """(question_id, question, status, answer, message): extractive unless a generator is named.

        message is what is said instead of an answer: to a blank question, where nothing is loaded,
        no context is asked for, nothing is found, or what is found doesn't fit in the prompt.
        """
        s, model = self.settings, model_config(self.model)
        loaded = self.is_ready()
        state = context.status(F.col("question"), F.lit(loaded), F.lit(use_context), F.lit(1))
        rows = questions.select("question_id", "question", state.alias("status"))
        none = F.lit(None).cast("string")
        if not loaded or not use_context:
            return rows.select("*", none.alias("answer"), context.message(F.col("status"), F.col("question")).alias("message"))
        hits = self.retrieve(questions.filter(state == "ok"), k or s.query_k, rerank)
        if generator is None:
            found = context.answers(hits, s)
        else:
            fitted = context.fit(hits, model["context_window"], model["max_tokens"], model["prompt_style"], k, s)
            body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_text"))), lambda x: x["chunk_text"]), "\n\n")  # as much as fits in a prompt
            prompts = fitted.groupBy("question_id", "question").agg(body.alias("context"))
            prompts = prompts.withColumn("prompt", context.prompt(F.col("context"), F.col("question"), F.lit(model["prompt_style"])))
            made = context.generate(prompts, generator).join(context.citations(fitted), "question_id").select("question_id", context.formatted(F.col("response"), F.col("citations")).alias("answer"))
            found = hits.select("question_id").distinct().join(made, "question_id", "left")  # hits without an answer: none fits
        rows = rows.join(found.select("question_id", "answer", F.lit(True).alias("_hits")), "question_id", "left")
        status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("_hits").isNull(), "no hits").when(F.col("answer").isNull(), "no room").otherwise("ok")
        rows = rows.withColumn("status", status)
        return rows.select("question_id", "question", "status", "answer", context.message(F.col("status"), F.col("question")).alias("message"))


def collection(model: str) -> str:
    """The name of the collection that holds a model's vectors."""
    return "chunks_" + model.translate(str.maketrans("/-", "__"))


def store_batch(into: store.Store, done: DataFrame, embedder: str, replace: bool = False) -> None:
    """Processed documents into the store: documents, chunks and vectors in one commit."""
    rows = chunking.explode_chunks(done.withColumn("doc", F.struct("filename", "path"))).select("doc.filename", "doc.path", "chunk_index", "chunk_text")
    embedded = vectors.embed(store.with_chunk_ids(rows), "chunk_text", embedder).withColumn("collection", F.lit(collection(embedder)))
    into.save(done.select("filename", "path", "doc_number"), rows, replace, embedded)
