"""Document structure as windows over lines: headings, sections, tables, paragraphs.

Every window is partitioned by document, so one shuffle by document serves all of them. A
section's parent is the last heading before it of a lower level, its end the next heading of its
own level or a lower one: with seven levels these are seven running last/first values, no stack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import W
from ..functions.text import strip, word_count

#: Heading kinds in order of precedence: name, pattern (any case), level, priority.
HEADINGS = [
    ("chapter", rf"^CHAPTER{W}+\d+", 0, "highest"),
    ("part", rf"^PART{W}+[IVX]+", 0, "highest"),
    ("major_section", rf"^SECTION{W}+\d+:", 1, "high"),
    ("appendix", rf"^APPENDIX{W}+[A-Z]", 1, "high"),
    ("enclosure", rf"^ENCLOSURE{W}+\d+:", 1, "high"),
    ("numbered_section", rf"^\d+\.{W}+[A-Z][A-Z{W[1:-1]}]+\.?", 2, "high"),
    ("subsection", rf"^\d+\.\d+\.{W}+[A-Z]", 3, "medium"),
    ("sub_subsection", rf"^\d+\.\d+\.\d+\.{W}+[A-Z]", 4, "low"),
    ("lettered_item", rf"^[a-z]\.{W}+", 5, "low"),
    ("numbered_item", rf"^\(\d+\){W}+", 6, "none"),
]
LEVELS = range(7)


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line, text): 0-based lines; a null text has none."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "text"))


def headings(of_lines: DataFrame) -> DataFrame:
    """Lines with bare, name, level, priority; the last three are null where a line is no heading.

    Only the pattern's position is computed by regular expressions; its fields are looked up.
    """
    bare = of_lines.withColumn("bare", strip(F.col("text")))
    number = F.lit(None).cast("int")
    for k in reversed(range(len(HEADINGS))):
        number = F.when(F.col("bare").rlike("(?i)" + HEADINGS[k][1]), F.lit(k)).otherwise(number)
    field = lambda i: F.get(F.array(*[F.lit(h[i]) for h in HEADINGS]), F.col("_k"))
    return bare.withColumn("_k", number).withColumns({"name": field(0), "level": field(2), "priority": field(3)}).drop("_k")


def sections(of_lines: DataFrame) -> DataFrame:
    """A row for each heading: doc, idx, line, header, name, level, priority, parent, content_start,
    content_end, has_content, next_idx (the first section after its subtree), words (its own)."""
    by_doc = Window.partitionBy("doc").orderBy("line")
    upto, before, after = by_doc.rowsBetween(Window.unboundedPreceding, 0), by_doc.rowsBetween(Window.unboundedPreceding, -1), by_doc.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("doc")
    marked = headings(of_lines).withColumns({"is_heading": F.col("level").isNotNull(), "n_words": word_count(F.col("bare"))})
    marked = marked.withColumns({
        "sec": F.sum(F.col("is_heading").cast("int")).over(upto) - 1,
        "texts_before": F.coalesce(F.sum((~F.col("is_heading") & (F.col("bare") != "")).cast("int")).over(before), F.lit(0)),
        "n_lines": F.count("*").over(whole),
        "n_texts": F.sum((~F.col("is_heading") & (F.col("bare") != "")).cast("int")).over(whole),
    })
    # Words of a section: its heading's and those of the lines up to the next heading of any level.
    marked = marked.withColumn("words", F.sum("n_words").over(Window.partitionBy("doc", "sec")))
    heads = marked.filter("is_heading").withColumn("n_sections", F.count("*").over(whole))
    at = F.struct(F.col("line"), F.col("texts_before").alias("texts"), F.col("sec").alias("idx"))
    previous = [F.when(F.col("level") > n, F.last(F.when(F.col("level") == n, F.col("sec")), ignorenulls=True).over(before)) for n in LEVELS]
    following = [F.when(F.col("level") >= n, F.first(F.when(F.col("level") == n, at), ignorenulls=True).over(after)) for n in LEVELS]
    heads = heads.withColumns({"parent": F.greatest(*previous), "end": F.least(*following)})
    return heads.select(
        "doc", F.col("sec").cast("int").alias("idx"), "line", F.col("bare").alias("header"), "name", "level", "priority", F.col("parent").cast("int").alias("parent"),
        (F.col("line") + 1).alias("content_start"),
        F.coalesce("end.line", F.col("n_lines")).cast("int").alias("content_end"),
        (F.coalesce("end.texts", F.col("n_texts")) > F.col("texts_before")).alias("has_content"),
        F.coalesce("end.idx", F.col("n_sections")).cast("int").alias("next_idx"),
        F.col("words").cast("int").alias("words"),
    )


def subtree_words(of_sections: DataFrame) -> DataFrame:
    """Sections with before (words of all earlier sections) and subtree (words of it and what is below)."""
    by_doc = Window.partitionBy("doc").orderBy("idx")
    before = F.coalesce(F.sum("words").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    with_sum = of_sections.withColumn("before", before)
    sums = with_sum.select("doc", F.col("idx").alias("next_idx"), F.col("before").alias("next_before"))
    total = F.sum("words").over(Window.partitionBy("doc"))
    return with_sum.withColumn("all_words", total).join(sums, ["doc", "next_idx"], "left").withColumn(
        "subtree", F.coalesce("next_before", "all_words") - F.col("before")
    ).drop("next_before", "all_words")


def section_content(of_lines: DataFrame) -> DataFrame:
    """(doc, idx, header, content): each section's heading and the lines up to the next heading.

    idx -1 holds the lines before the first heading, with a null header.
    """
    upto = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = headings(of_lines).withColumn("idx", (F.sum(F.col("level").isNotNull().cast("int")).over(upto) - 1).cast("int"))
    body = F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line", "text"))))
    return marked.groupBy("doc", "idx").agg(F.max(F.when(F.col("level").isNotNull(), F.col("bare"))).alias("header"), body.alias("_body")).select(
        "doc", "idx", "header", F.array_join(F.transform("_body", lambda x: x["text"]), "\n").alias("content")
    )


def sections_by_level(of_sections: DataFrame) -> DataFrame:
    """(doc, level, n, indexes): a document's sections of each level, in order."""
    return of_sections.groupBy("doc", "level").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("idx")).alias("indexes"))


def table_spans(of_lines: DataFrame) -> DataFrame:
    """(doc, start_line, name, end_line): each end marker whose last marker before it is a start."""
    start = F.col("text").contains("=== TABLE") & F.col("text").contains("START ===")
    end = ~start & F.col("text").contains("=== TABLE") & F.col("text").contains("END ===")
    marks = of_lines.withColumns({"is_start": start, "is_end": end}).filter("is_start or is_end")
    before = F.lag(F.struct("is_start", "line", "text")).over(Window.partitionBy("doc").orderBy("line"))
    return marks.withColumn("before", before).filter("is_end and before.is_start").select(
        "doc", F.col("before.line").alias("start_line"), strip(F.col("before.text")).alias("name"), F.col("line").alias("end_line"), (F.col("line") + 1).alias("content_end")
    )


def paragraph_spans(of_lines: DataFrame) -> DataFrame:
    """(doc, start_line, end_line): maximal runs of lines that aren't blank."""
    text = of_lines.filter(strip(F.col("text")) != "")
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc").orderBy("line"))
    return text.withColumn("island", island).groupBy("doc", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("island")
