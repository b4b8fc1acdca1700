import pytest

LONG = "the long text goes on and on. " * 20_000
ROWS = [
    (1, "The same  words here", "en", "a", 20), (2, "The same\twords here", "en", "b", 20), (2, "The same\twords here", "en", "b", 20),
    (None, "The same words here", None, None, None), (3, None, None, "a", None), (4, "", "fr", "a", 0), (5, LONG, "en", "hot", 1), (6, " \n ", None, None, None),
    (7, "12 34 !!", "de", "b", 8), (None, None, None, None, None), (8, "der die das und ist nicht", "de", "b", 1), (9, "le la les un une des", "fr", "a", 1),
    (10, "ünïcödé 😀 text\x00with\u2028odd marks", "en", "c", 1),
]
CLASH = ["score", "kept", "fp", "hash", "sha", "norm", "img", "_key", "_copy", "copy", "lang_pred", "ids", "host", "path", "rule", "label", "bucket", "_id", "_sha", "_first", "node", "root", "salt"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, repeated rows, odd texts, and columns with clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="session")
def plain(odd):
    return odd.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
