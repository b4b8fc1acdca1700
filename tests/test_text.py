import pytest
from pyspark.sql import functions as F

from folioflux.functions import text as T


def value(spark, column, **inputs):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, int) else 'long'}" for k, v in inputs.items())
    return spark.createDataFrame([tuple(inputs.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("name", "page", "number"), [
    ("500085p.pdf", None, "5000.85"), ("1500085p.pdf", None, "5000.85"), ("DODI 5000.85.pdf", None, "5000.85"), ("dodm_4140.01.txt", None, "4140.01"),
    ("notes.pdf", "NUMBER 5000.56", "5000.56"), ("notes.pdf", "see DODD 1.5 there", "1.5"), ("notes.pdf", None, None), (None, None, None),
])
def test_document_number(spark, name, page, number):
    assert value(spark, T.document_number(F.col("n"), None, F.col("p")), n=name, p=page) == number


def test_toc_is_removed_only_where_it_ends(spark):
    text = "intro\nTable of Contents\nScope .... 3\nSECTION 1: Scope\nbody\nin the year 1999\nCHAPTER 3"
    assert value(spark, T.remove_toc(F.col("t")), t=text) == "SECTION 1: Scope\nbody"
    assert value(spark, T.remove_toc(F.col("t")), t="intro\nTABLE OF CONTENTS\nbody") == "intro\nTABLE OF CONTENTS\nbody"


def test_clean(spark):
    text = "first line\n12\n13\nPage 2 of 9\nab\n\n\n\n\nlast\tline ,\f end\n1234\nx"
    assert value(spark, T.clean(F.col("t")), t=text) == "first line\nlast line, end"
    assert value(spark, T.clean(F.col("t")), t=None) == ""


def test_urls_keep_their_dots(spark):
    text = "see https://www.example.com/a.b , and https://www.example.com .then"
    assert value(spark, T.fix_spacing(F.col("t")), t=text) == "see https://www.example.com/a.b, and https://www.example.com. then"
    assert value(spark, T.final_cleanup(F.col("t"), shield_urls=False), t="www.example.com") == "www. example. com"
    assert value(spark, T.final_cleanup(F.col("t")), t="e.g.foo ; x") == "e. g. foo; x"


def test_words_tokens_sentences(spark):
    assert value(spark, T.word_count(F.col("t")), t=" a b\x1cc ") == 3
    assert value(spark, T.word_count(F.col("t")), t=None) == 0
    assert value(spark, T.token_estimate(F.col("t")), t="one two three") == 3
    assert value(spark, T.token_estimate(F.col("t")), t="x" * 40) == 10
    assert value(spark, T.sentences(F.col("t")), t="One. Two!  Three") == ["One.", "Two!", "Three"]


@pytest.mark.parametrize(("n", "groups"), [("5000.85", (5000, 5000, 5000)), ("4140.01", (4000, 4100, 4140)), ("51.2", (5000, 5100, None)), ("", (None, None, None)), (None, (None, None, None)), ("0123.4", (0, 100, 120))])
def test_taxonomy(spark, n, groups):
    assert tuple(value(spark, T.taxonomy(F.col("n"), k), n=n) for k in (1, 2, 3)) == groups


def test_truncate_pair(spark):
    room = 2048 - 10 - 20
    late, early = "x" * (int(room * 0.81)) + "." + "y" * 3000, "x" * (int(room * 0.79)) + "." + "y" * 3000
    cut = lambda q, p: value(spark, T.truncate_pair(F.col("q"), F.col("p")), q=q, p=p)
    assert cut("q" * 10, late) == late[: int(room * 0.81) + 1]
    assert cut("q" * 10, early) == early[:room]
    spaced = "x" * int(room * 0.91) + " " + "y" * 3000
    assert cut("q" * 10, spaced) == "x" * int(room * 0.91)
    assert cut("q" * 2000, "p" * 500) == "p" * 100
    assert cut("short", "short") == "short"


def test_format_table_and_input(spark):
    rows = F.expr("array(array('a', null, ' '), null, array('b\\nc', 'd'))")
    got = value(spark, T.format_table(rows, F.lit(1), F.lit(2)), x=1)
    assert got == "=== TABLE 1.2 START ===\na\nb | c || d\n=== TABLE 1.2 END ==="
    assert value(spark, T.input_error(F.col("t")), t="a" * 1001).startswith("Input too long")
    assert value(spark, T.input_error(F.col("t")), t="a<b>c<") == "Invalid characters not allowed: '<', '>'. Please remove these characters and try again."
    assert value(spark, T.input_error(F.col("t")), t=None) is None
