"""Re-ranking of hits: by their document's relation to the top hit, then by a second scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import strip, taxonomy, truncate_pair, words
from ..session import ship

SCORERS: dict[str, Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]] = {}


def adjacency(distance: Column, s: Settings = DEFAULT) -> Column:
    """Boost for chunks near the top hit in the same file; distance 0 counts as near by."""
    return F.when(distance == 1, F.lit(s.adjacent)).when(distance == 2, F.lit(s.near)).when(distance <= 5, F.lit(s.nearby)).otherwise(F.lit(1.0))


def by_document(hits: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Hits (question_id, rank, similarity, filename, doc_number, chunk_index, ...) re-ranked.

    Adds relationship, document_boost, adjacency_boost, original_similarity, and new similarity and
    rank. The top hit keeps its score (relationship null) but may be overtaken. A group number of
    0 matches nothing. Ties keep their order.
    """
    by_rank = Window.partitionBy("question_id").orderBy("rank")
    top = {c: F.first(c).over(by_rank) for c in ("filename", "doc_number", "chunk_index")}
    rows = hits.withColumns({f"_top_{c}": v for c, v in top.items()}).withColumn("_first", F.col("rank") == F.min("rank").over(by_rank))
    present = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    number = present("doc_number") & present("_top_doc_number")

    def related(digits: int) -> Column:
        mine, theirs = taxonomy(F.col("doc_number"), digits), taxonomy(F.col("_top_doc_number"), digits)
        return number & (theirs != 0) & (mine == theirs)

    same_file = present("filename") & (F.col("filename") == F.col("_top_filename"))
    relation = (
        F.when(F.col("_first"), F.lit(None).cast("string"))
        .when(same_file, "same_document")
        .when(number & (F.col("doc_number") == F.col("_top_doc_number")), "same_doc_number")
        .when(related(3), "same_specific_range")
        .when(related(2), "same_subgroup")
        .when(related(1), "same_major_group")
        .otherwise("unrelated")
    )
    boosts = {"same_document": s.same_document, "same_doc_number": s.same_number, "same_specific_range": s.same_range, "same_subgroup": s.same_subgroup, "same_major_group": s.same_major, "unrelated": 1.0 / s.same_major}
    boost = F.lit(1.0)
    for name, value in boosts.items():
        boost = F.when(F.col("relationship") == name, F.lit(value)).otherwise(boost)
    near = F.when(~F.col("_first") & same_file & F.col("chunk_index").isNotNull() & F.col("_top_chunk_index").isNotNull(), adjacency(F.abs(F.col("chunk_index") - F.col("_top_chunk_index")), s)).otherwise(F.lit(1.0))
    rows = rows.withColumn("relationship", relation).withColumns({"document_boost": boost, "adjacency_boost": near, "original_similarity": F.col("similarity")})
    rows = rows.withColumn("similarity", F.col("similarity") * F.col("document_boost") * F.col("adjacency_boost"))
    again = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), "rank"))
    return rows.withColumn("rank", again).drop("_first", *[f"_top_{c}" for c in top])


def lexical_score(question: Column, passage: Column) -> Column:
    """The default second scorer: the share of the question's different words that the passage has."""
    asked, there = F.array_distinct(words(F.lower(question))), F.array_distinct(words(F.lower(passage)))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, there)) / F.size(asked).cast("double")).otherwise(0.0)


def scorer_column(name: str, question: Column, passage: Column) -> Column:
    """A registered scorer as a column: SCORERS[name]() is made once a worker, then scores batches."""
    factory = SCORERS[name]

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, p in batches:
            yield model(q, p)

    return run(question, passage)


def rerank(hits: DataFrame, s: Settings = DEFAULT, question: str = "question", text: str = "chunk_text", scorer: str | None = None) -> DataFrame:
    """The first rerank_top hits by a second score, of these the final_top best; the other hits after them.

    Adds cross_score (null for hits that were not scored; blank passages get blank_score) and sets
    rank. The rest of the head is dropped: it was scored and lost.
    """
    ship(hits.sparkSession)
    head = F.col("rank") <= s.rerank_top
    passage = truncate_pair(F.col(question), F.col(text), s)
    score = scorer_column(scorer, F.col(question), passage) if scorer else lexical_score(F.col(question), passage)
    blank = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    rows = hits.withColumn("cross_score", F.when(head, F.when(blank, F.lit(s.blank_score)).otherwise(score)))
    order = Window.partitionBy("question_id").orderBy(F.when(head, 0).otherwise(1), F.desc("cross_score"), "rank")
    rows = rows.withColumns({"_head": head, "_place": F.row_number().over(order)}).filter(~F.col("_head") | (F.col("_place") <= s.final_top))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("_place"))).drop("_head", "_place")


def score_stats(reranked: DataFrame) -> DataFrame:
    return reranked.groupBy("question_id").agg(F.min("cross_score").alias("min_score"), F.max("cross_score").alias("max_score"), F.avg("cross_score").alias("mean_score"))
