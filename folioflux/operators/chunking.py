"""Chunks: whole sections where a document has headings, packed sentences where it has none.

The cutting itself is `passages`, in plain Python; here it is made into column functions that run over
Arrow batches of the text column alone. Folds over words and sentences can be written with Spark's
array functions too, but those are interpreted: measured, they took ten times as long. A document
never leaves its row, and nothing is shuffled.

compat=True keeps the plain rules' losses and repeats; see `passages`.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import cleaning
from ..functions.arrow import column
from ..functions.text import word_count
from ..session import ship
from . import passages

STRINGS = "array<string>"
TREE = "array<struct<idx:int,line:int,level:int,parent:int,next_idx:int,text:string,before:int,subtree:int,has_content:boolean>>"
DONE = "struct<clean_text:string,chunks:array<string>>"


def split_at_punctuation(sentence: Column, s: Settings = DEFAULT, ahead: int = 50, compat: bool = False) -> Column:
    return column(lambda x: passages.split_at_punctuation(x, s, ahead, compat), STRINGS, sentence)


def pack_sentences(text: Column, s: Settings = DEFAULT, compat: bool = False) -> Column:
    return column(lambda x: passages.pack_sentences(x, s, compat), STRINGS, text)


def fallback_chunks(text: Column, s: Settings = DEFAULT, compat: bool = False) -> Column:
    return column(lambda x: passages.fallback_chunks(x, s, compat), STRINGS, text)


def table_aware_split(text: Column, s: Settings = DEFAULT) -> Column:
    return column(lambda x: passages.table_aware_split(x, s), STRINGS, text)


def merge_small(chunks: Column, s: Settings = DEFAULT) -> Column:
    return column(lambda x: passages.merge_small(x, s), STRINGS, chunks)


def overlap_text(before: Column, chunk: Column, s: Settings = DEFAULT) -> Column:
    return column(lambda x, y: passages.overlap_text(x, y, s), "string", before, chunk)


def apply_overlap(chunks: Column, s: Settings = DEFAULT) -> Column:
    return column(lambda x: passages.apply_overlap(x, s), STRINGS, chunks)


def crosses_boundary(levels1: Column, ids1: Column, levels2: Column, ids2: Column) -> Column:
    """Whether two chunks hold sections of level 2 or less, and none in common; null lists: false."""
    major = lambda levels, ids: F.filter(F.arrays_zip(levels.alias("l"), ids.alias("i")), lambda x: x["l"] <= 2)
    a, b = (F.transform(major(x, y), lambda z: z["i"]) for x, y in ((levels1, ids1), (levels2, ids2)))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


def enforce_size(chunks: Column, s: Settings = DEFAULT, compat: bool = False) -> Column:
    return column(lambda x: passages.enforce_size(x, s, compat), STRINGS, chunks)


def finish(chunks: Column, s: Settings = DEFAULT, compat: bool = False) -> Column:
    return column(lambda x: passages.finish(x, s, compat), STRINGS, chunks)


def section_tree(lines: Column) -> Column:
    """A document's lines (array) to its sections (array of structs, as passages.Section)."""
    return column(lambda x: [section._asdict() for section in passages.section_tree(x)], TREE, lines)


def hierarchical_chunks(text: Column, s: Settings = DEFAULT, compat: bool = False) -> Column:
    return column(lambda x: passages.hierarchical_chunks(x, s, compat), STRINGS, text)


def chunks_of(text: Column, s: Settings = DEFAULT, compat: bool = False) -> Column:
    """The chunks of a cleaned text."""
    return column(lambda x: passages.chunk(x, s, compat), STRINGS, text)


def with_chunks(docs: DataFrame, text: str, into: str = "chunks", s: Settings = DEFAULT, compat: bool = False, cleaned: bool = False) -> DataFrame:
    """docs with an array of each text's chunks, from cleaning to the size cap.

    Blank text has none; a short one is one chunk. cleaned: the text is clean already (compat
    cleans it again all the same, which is not the same as once). No shuffle.
    """
    s.checked()
    whole = lambda x: passages.chunk(x if cleaned and not compat else cleaning.clean(x, s), s, compat)
    return docs.withColumn(into, column(whole, STRINGS, F.col(text)))


def processed(text: Column, s: Settings = DEFAULT, compat: bool = False) -> Column:
    """(clean_text, chunks) of a text, in one pass. It is cleaned once; compat cleans it again before cutting."""
    s.checked()

    def run(x: str) -> dict[str, Any]:
        clean = cleaning.clean(x, s)
        return {"clean_text": clean, "chunks": passages.chunk(cleaning.clean(clean, s) if compat else clean, s, compat)}

    return column(run, DONE, text)


def chunk_documents(docs: DataFrame, s: Settings = DEFAULT, doc: str = "doc_id", text: str = "text", compat: bool = False) -> DataFrame:
    """(doc, chunks) for every row."""
    return with_chunks(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), "text", "chunks", s, compat).select("doc", "chunks")


def explode_chunks(chunked: DataFrame) -> DataFrame:
    """(doc, chunk_index, chunk_text): 0-based."""
    return chunked.select("doc", F.posexplode("chunks").alias("chunk_index", "chunk_text"))


def chunk_stats(chunks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Number, average words, and how many are over and under size, from (chunk_text)."""
    n = word_count(F.col("chunk_text"))
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg(n).alias("avg_words"), F.count_if(n > s.max_words).alias("n_over"), F.count_if(n < s.min_words).alias("n_under"))


def register(spark: SparkSession, name: str = "chunk_text") -> None:
    """Make a table function for SQL: SELECT * FROM chunk_text('...'), or LATERAL to a column of texts."""
    ship(spark)

    @F.udtf(returnType="chunk_index int, chunk_text string")
    class ChunkText:
        def eval(self, text: str):  # noqa: ANN202
            yield from enumerate(passages.chunk(cleaning.clean(text or "")))

    spark.udtf.register(name, ChunkText)
