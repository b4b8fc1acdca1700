"""The corpus pipeline: language ID, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet and
reads it again for the next. All but the last return the columns of documents.

Every stage takes any rows: nulls in any column, empty and very long texts, repeated rows, rows that
tie, an empty table (which stays empty), and extra columns of any name, which all but the last keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm import bpe, exact, langid, mixing, queries, simhash
from folioflux.llm.common import fresh_dir, held_out, table, written

#: Documents whose language is surer than this stay; und has score 0.
LEAST_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows. The model learns as op3's does.

    Rows without an id are judged too, by their own text: the model's answer is a function of the
    text, so it is added as a column and no join is needed.
    """
    model = langid.train(table(spark, sf_dir, "documents").filter(held_out(F.col("doc_id"), 5) != 0))
    return langid.accepted(docs, model, LEAST_SCORE)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, by white space normalised: that with the least id, rows without an id last.

    Null and empty texts are one text; ties go by all columns.
    """
    return exact.one_of_each(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that with the least id, rows without an id last.

    Null, empty and blank texts have fingerprint zero; ties go by the text's digest, then by all columns.
    """
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated to the sources' target weights, and shuffled.

    A document's copies follow from its id and its source's rate, so rows that share both are
    repeated alike; a null source is one of its own, and one without any text goes.
    """
    return mixing.mix(docs, queries.WEIGHTS, seed=queries.SEED).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's number of tokens, and the digests of its ids and of the decoded bytes; a null text has none."""
    return bpe.digests(docs, *queries.ranks())


STAGES = [
    ("language", language),
    ("exact duplicates", exact_duplicates),
    ("near duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Language ID, SimHash and BPE can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{path}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
