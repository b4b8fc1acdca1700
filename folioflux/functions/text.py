"""Column functions on text: counting, splitting, truncating, in the JVM; cleaning over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from . import cleaning
from .arrow import column
from .patterns import TOC_LINES, URL, W

WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
NOT_W = "[^" + W[1:]
SENTENCE_GAP = f"(?<=[.!?]){W}+"


#: Embedding models whose collections are known, the known folders, and where they are.
KNOWN_MODELS = ["all-MiniLM-L6-v2", "all-mpnet-base-v2", "BAAI/bge-base-en-v1.5", "mixedbread-ai/mxbai-embed-large-v1"]
FOLDERS, FOLDERS_BELOW = ["dodd", "dodi", "dodm", "test"], "policies/"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it.

    A column expression is a tree: used twice, it is there twice, and a chain of such uses grows
    without bound. Inside body the value is a lambda's variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _empty(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def strip(t: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(t, F.lit(WHITE))


def word_count(t: Column) -> Column:
    return F.regexp_count(_empty(t), F.lit(f"{NOT_W}+")).cast("int")


def words(t: Column) -> Column:
    """The words, in order; an empty array for blank text."""
    return F.regexp_extract_all(_empty(t), F.lit(f"{NOT_W}+"), F.lit(0))


def sentences(t: Column) -> Column:
    """Split at white space after . ! or ?; blank text gives itself."""
    return F.split(_empty(t), SENTENCE_GAP)


def whole_sentences(t: Column) -> Column:
    """Trimmed sentences, without blank ones."""
    return F.filter(F.transform(sentences(strip(_empty(t))), strip), lambda s: s != "")


def token_estimate(t: Column) -> Column:
    """The larger of 1.3 a word and a quarter of the characters, each rounded down."""
    return F.greatest(F.floor(word_count(t) * F.lit(1.3)), F.floor(F.length(_empty(t)) / F.lit(4))).cast("int")


def is_toc_line(line: Column) -> Column:
    return (line != "") & line.rlike("|".join(TOC_LINES))


def remove_toc(t: Column) -> Column:
    """Drop everything before the line that ends a table of contents, and lines that look like its
    entries anywhere."""
    return column(cleaning.remove_toc, "string", t)


def _spaced(t: Column) -> Column:
    t = F.regexp_replace(t, f"{W}+([.,;:!?])", "$1")
    return F.regexp_replace(t, f"([.!?]){W}*([a-z])", "$1 $2")


def fix_spacing(t: Column) -> Column:
    """Spacing around punctuation, with URLs left as they are.

    The text between URLs is mended piece by piece; a URL stands for an ordinary character, so
    white space around it stays unless punctuation follows.
    """
    def mended(x: Column) -> Column:
        pieces = F.split(_spaced(F.regexp_replace(x, URL, "\u0001")), "\u0001")
        urls = F.regexp_extract_all(x, F.lit(URL), F.lit(0))
        joined = F.array_join(F.zip_with(pieces, urls, lambda a, u: F.concat(F.coalesce(a, F.lit("")), F.coalesce(u, F.lit("")))), "")
        return F.when(x.rlike(URL), joined).otherwise(_spaced(x))

    return let(t, mended)


def clean(t: Column, s: Settings = DEFAULT) -> Column:
    """Clean extracted text but keep its lines: tables of contents, page numbers and very short lines go."""
    return column(lambda x: cleaning.clean(x, s), "string", t)


def final_cleanup(t: Column, shield_urls: bool = True) -> Column:
    """White space and punctuation of a finished chunk. shield_urls=False also spaces out the dots in URLs."""
    t = F.regexp_replace(_empty(t), "[ \\t]+", " ")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    return strip(fix_spacing(t) if shield_urls else _spaced(t))


def document_number(filename: Column, title: Column | None = None, first_page: Column | None = None) -> Column:
    """A document's number like 5000.85, from its file name, title or first page; the first hit wins."""
    standard = r"(?i)DOD[IDM][\s_-]?(\d+\.\d+)"

    def hit(t: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(_empty(t), pattern, 1), F.lit(""))

    compact = r"(?i)(\d{4})(\d{2})p?\.pdf$"
    parts = [F.regexp_extract(filename, compact, k) for k in (1, 2)]
    tries = [F.when(_empty(filename).rlike(compact), F.concat_ws(".", *parts)), hit(filename, standard)]
    if title is not None:
        tries.append(hit(title, standard))
    if first_page is not None:
        tries += [hit(first_page, r"(?i)NUMBER\s+(\d+\.\d+)"), hit(first_page, standard)]
    return F.coalesce(*tries)


def taxonomy(number: Column, digits: int) -> Column:
    """The group of a number by its first 1, 2 or 3 digits, as thousands, hundreds or tens."""
    whole = F.split_part(number, F.lit("."), F.lit(1))
    return F.when((_empty(number) != "") & (F.length(whole) >= digits), F.substring(whole, 1, digits).try_cast("int") * {1: 1000, 2: 100, 3: 10}[digits])


def chunk_id(path: Column, filename: Column, index: Column) -> Column:
    tail = F.concat_ws("_", filename, index.cast("string"))
    return F.when(_empty(path) != "", F.concat_ws("_", F.substring(F.md5(path), 1, 8), tail)).otherwise(tail)


def collection_name(model: Column, prefix: str = "chunks_") -> Column:
    return F.concat(F.lit(prefix), F.translate(model, "/-", "__"))


def model_of_collection(name: Column, prefix: str = "chunks_") -> Column:
    """The model whose vectors a collection holds: one that is known, else by the name's underscores as slashes."""
    rest = F.regexp_replace(name, f"^{prefix}", "")
    out = F.translate(rest, "_", "/")
    for model in KNOWN_MODELS:
        out = F.when(rest == model.replace("/", "_").replace("-", "_"), F.lit(model)).otherwise(out)
    return out


def folder_path(name: Column) -> Column:
    """Where a chosen folder is: the known ones are below one folder, others are taken as they are."""
    return F.when(name.isin(*FOLDERS), F.concat(F.lit(FOLDERS_BELOW), name)).otherwise(name)


def truncate_pair(question: Column, passage: Column, s: Settings = DEFAULT) -> Column:
    """The passage cut so that question and passage fit the scorer: at a late full stop, else a late space."""
    most = s.pair_tokens * 4
    room = F.lit(most) - F.length(question) - 20
    cut = F.substring(passage, F.lit(1), F.greatest(room, F.lit(0)))

    def last(mark: str) -> Column:
        at = F.instr(F.reverse(cut), F.lit(mark))
        return F.when(at > 0, F.length(cut) - at).otherwise(-1)

    shorter = F.when(last(".") > room * F.lit(0.8), F.substring(cut, F.lit(1), last(".") + 1)).when(
        last(" ") > room * F.lit(0.9), F.substring(cut, F.lit(1), last(" "))).otherwise(cut)
    return F.when(F.length(question) + F.length(passage) <= most, passage).when(room < 100, F.substring(passage, 1, 100)).otherwise(shorter)


def format_table(rows: Column, page: Column, number: Column) -> Column:
    """Table cells (array of arrays of strings) as marked lines; blank cells and rows go. page and number count from 1."""
    cell = lambda c: F.replace(strip(c), F.lit("\n"), F.lit(" | "))
    lines = F.transform(rows, lambda r: F.array_join(F.filter(F.transform(F.filter(F.coalesce(r, F.array().cast("array<string>")), lambda c: c.isNotNull()), cell), lambda c: c != ""), " || "))
    mark = lambda word: F.concat(F.lit("=== TABLE "), page.cast("string"), F.lit("."), number.cast("string"), F.lit(f" {word} ==="))
    body = F.filter(lines, lambda x: x != "")
    return F.when(F.size(F.coalesce(rows, F.array())) > 0, F.array_join(F.concat(F.array(mark("START")), body, F.array(mark("END"))), "\n")).otherwise("")


def blocked_characters(t: Column) -> Column:
    """Different characters of a question that are not allowed, in the order of their first use."""
    return F.array_distinct(F.regexp_extract_all(_empty(t), F.lit(r"[|`$\{\}\[\]<>\\]"), F.lit(0)))


def input_error(t: Column, s: Settings = DEFAULT) -> Column:
    """Why a question is refused, or null."""
    bad = blocked_characters(t)
    return F.when(F.length(_empty(t)) > s.max_question_chars, F.lit(f"Input too long (max {s.max_question_chars} characters)")).when(
        F.size(bad) > 0, F.concat(F.lit("Invalid characters not allowed: '"), F.array_join(bad, "', '"), F.lit("'. Please remove these characters and try again.")))
