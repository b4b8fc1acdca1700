"""From ranked hits to answers: the prompt's budget, prompts, citations, and the answer's form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, PROMPTS, Settings
from ..functions.text import strip, word_count
from ..session import ship

GENERATORS: dict[str, Callable[[], Callable[[pd.Series], pd.Series]]] = {}
#: Lead-ins that a generator may give and that are taken off once.
LEAD_INS = ["Based on the DOD policies above,", "Based on the context provided,", "According to the DOD policies,"]
#: What answers begin with, what stands for a missing text, and the note of an answer without a generator.
LEAD = "Based on DOD policies: "
MISSING = "[Text unavailable for chunk {}]"
NOTE = "Note: LLM not available, showing simplified response."
#: What is said instead of an answer; {} is the question.
BLANK = "Please provide a valid question."
NOT_LOADED = "Please load documents first using load_documents()"
NO_CONTEXT = "Simple response for: '{}' (no context retrieval)"
NO_HITS = "No relevant policy information found for: '{}'"
TOO_LARGE = "Context chunks too large for available token space"


def template(style: Column) -> Column:
    """The prompt template of a style; unknown styles get the fallback."""
    found = F.lit(PROMPTS["fallback"])
    for name, text in PROMPTS.items():
        found = F.when(style == name, F.lit(text)).otherwise(found)
    return found


def prompt(context: Column, question: Column, style: Column) -> Column:
    """The context goes in last, so braces in it stay as they are."""
    parts = F.split(F.replace(template(style), F.lit("{question}"), question), r"\{context\}", 2)
    return F.concat(F.get(parts, F.lit(0)), context, F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def fit(hits: DataFrame, context_window: int, max_tokens: int, style: str = "simple", max_chunks: int | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Hits (question_id, question, rank, chunk_text, ...) that fit in the prompt: a prefix by rank.

    Adds prompt_tokens (of the prompt up to this hit) and utilisation in percent. Words and
    characters add up under the blank-line join, so one running sum replaces rendering the prompt
    for each prefix; it never falls, so the prefix is a filter.
    """
    room = context_window - max_tokens - s.prompt_reserve
    empty = prompt(F.lit(""), F.col("question"), F.lit(style))
    upto = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    n_words = word_count(empty) + F.sum(word_count(F.col("chunk_text"))).over(upto)
    n_chars = F.length(empty) + F.sum(F.length("chunk_text")).over(upto) + 2 * (F.row_number().over(Window.partitionBy("question_id").orderBy("rank")) - 1)
    tokens = F.greatest(F.floor(n_words * F.lit(1.3)), F.floor(n_chars / F.lit(4)))
    rows = hits.withColumn("prompt_tokens", tokens.cast("long")).withColumn("utilisation", F.round(F.col("prompt_tokens") * 100.0 / F.lit(float(max(room, 1))), 1) if room > 0 else F.lit(0.0))
    rows = rows.filter(F.col("prompt_tokens") <= room)
    return rows.filter(F.col("rank") <= max_chunks) if max_chunks else rows


def citations(fitted: DataFrame) -> DataFrame:
    """(question_id, citations): the different document numbers of the hits used, sorted."""
    number = strip(F.col("doc_number"))
    return fitted.groupBy("question_id").agg(F.sort_array(F.collect_set(F.when(number != "", number))).alias("citations"))


def formatted(response: Column, cited: Column) -> Column:
    """An answer: stripped, one known lead-in off, the lead on, sources at the end."""
    bare = strip(response)
    out = bare
    for lead in reversed(LEAD_INS):
        out = F.when(bare.startswith(lead), strip(F.substring(bare, F.lit(len(lead) + 1), F.length(bare)))).otherwise(out)
    sources = F.when(F.size(F.coalesce(cited, F.array().cast("array<string>"))) > 0, F.concat(F.lit("\n\nSources: "), F.array_join(cited, ", "))).otherwise("")
    return F.concat(F.lit(LEAD), out, sources)


def excerpt(first: Column, question: Column, n: Column, s: Settings = DEFAULT, note: bool = True) -> Column:
    """The answer without a generator: the first hit's beginning and the number of hits. note: one was asked for."""
    return F.concat(
        F.lit("Based on DOD policies, here's what I found regarding '"), question, F.lit("':\n\nRelevant policy excerpt:\n"),
        F.substring(first, 1, s.excerpt_chars), F.lit(f"...\n\n{NOTE if note else ''}\n\nFound "), n.cast("string"), F.lit(" relevant policy sections."),
    )


def status(question: Column, loaded: Column, use_context: Column, n_hits: Column) -> Column:
    """Why a question gets no answer from the context, or 'ok'."""
    return (
        F.when(strip(F.coalesce(question, F.lit(""))) == "", "blank question")
        .when(~loaded, "nothing loaded")
        .when(~use_context, "no context asked for")
        .when(n_hits == 0, "no hits")
        .when(n_hits < 0, "no room")
        .otherwise("ok")
    )


def message(state: Column, question: Column) -> Column:
    """What is said to a question in a state that status() gives; null for 'ok'."""
    said = lambda text: F.concat(F.lit(text.split("{}")[0]), question, F.lit(text.split("{}")[1]))
    return (
        F.when(state == "blank question", F.lit(BLANK)).when(state == "nothing loaded", F.lit(NOT_LOADED)).when(state == "no context asked for", said(NO_CONTEXT))
        .when(state == "no hits", said(NO_HITS)).when(state == "no room", F.lit(TOO_LARGE))
    )


def preview(text: Column, s: Settings = DEFAULT) -> Column:
    return F.when(F.length(text) > s.preview_chars, F.concat(F.substring(text, 1, s.preview_chars), F.lit("..."))).otherwise(text)


def display(hits: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(question_id, rank, shown): hits as they are shown, numbered by rank: source, number, scores to three places, the text's beginning."""
    number = F.when(strip(F.coalesce("doc_number", F.lit(""))) != "", F.concat(F.lit("Document Number: "), "doc_number"))
    lines = [F.format_string("[Chunk %d] Source: %s", F.col("rank").cast("long"), F.coalesce("filename", F.lit("Unknown"))), number, F.format_string("Similarity: %.3f", F.coalesce("similarity", F.lit(0.0)))]
    if "cross_score" in hits.columns:
        lines.append(F.when(F.col("cross_score").isNotNull(), F.format_string("Cross-encoder Score: %.3f", "cross_score")))
    return hits.select("question_id", "rank", F.concat_ws("\n", *lines, F.lit("-" * 40), preview(F.coalesce("chunk_text", F.lit("")), s)).alias("shown"))


def response_parts(text: Column) -> Column:
    """(answer, details) of a printed response: what follows the line "Response:", and what stands before it."""
    parts = F.split(text, "\nResponse:\n", 2)
    return F.when(F.size(parts) == 2, F.struct(strip(F.get(parts, F.lit(1))).alias("answer"), strip(F.get(parts, F.lit(0))).alias("details"))).otherwise(
        F.struct(text.alias("answer"), F.lit("").alias("details")))


def with_text(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with their chunk's text, or a placeholder where the store lacks it. Join after the top k."""
    texts = chunks.select(key, F.col("chunk_text").alias("_text"))
    return hits.join(texts, key, "left").withColumn("chunk_text", F.coalesce("_text", F.format_string(MISSING.replace("{}", "%s"), F.col(key).cast("string")))).drop("_text")


def generate(prompts: DataFrame, generator: str, column: str = "prompt") -> DataFrame:
    """prompts with a response from a registered generator, made once a worker."""
    ship(prompts.sparkSession)
    factory = GENERATORS[generator]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield model(batch)

    return prompts.withColumn("response", run(F.col(column)))


def answers(hits: DataFrame, s: Settings = DEFAULT, note: bool = True) -> DataFrame:
    """(question_id, question, answer): extractive answers from the ranked hits (question_id, question, rank, chunk_text)."""
    found = hits.groupBy("question_id", "question").agg(F.min_by("chunk_text", "rank").alias("first"), F.count("*").alias("n"))
    return found.select("question_id", "question", excerpt(F.col("first"), F.col("question"), F.col("n"), s, note).alias("answer"))
