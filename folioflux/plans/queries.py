"""Named queries over the test tables, and DuckDB SQL for the same rows.

The tables hold no file names, headings or document numbers, so the queries derive them: a
document's file is named after its source, its number follows from its id, and `outline` and
`messy` give its text headings, page numbers and the like. The SQL derives the same.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EMBEDDING_FROM_GB, LLM_MODELS, PROMPTS, TIER_FROM_GB, embedding_models, llm_models, tiers
from ..functions import text as T
from ..operators import chunking, context, ranking, store, structure, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
S = DEFAULT


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path that driver and executors share: below spark.checkpoint.dir where it is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='folioflux-')}/{name}-{uuid.uuid4().hex}"


# --- derived inputs, in Spark and in SQL ----------------------------------------------------------

NUMBER = "lpad(cast((doc_id * 37) % 10000 as string), 4, '0') || '.' || lpad(cast(doc_id % 100 as string), 2, '0')"
NUMBER_SQL = NUMBER.replace("string", "varchar")
FILES = {
    "filename": "coalesce(source, 'none') || '.pdf'", "path": "'/corpus/' || coalesce(source, 'none')",
    "chunk_index": "cast(floor(doc_id / 20) as int)", "doc_number": NUMBER,
}
CHUNKS_SQL = f"(SELECT doc_id, coalesce(source, 'none') || '.pdf' AS filename, '/corpus/' || coalesce(source, 'none') AS path, floor(doc_id / 20)::INT AS chunk_index, {NUMBER_SQL} AS doc_number, text AS chunk_text, substr(md5('/corpus/' || coalesce(source, 'none')), 1, 8) || '_' || coalesce(source, 'none') || '.pdf_' || floor(doc_id / 20)::INT AS chunk_id FROM documents)"


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as chunks: a file for each source."""
    docs = table(spark, sf, "documents").select("doc_id", *[F.expr(e).alias(k) for k, e in FILES.items()], F.col("text").alias("chunk_text"))
    return store.with_chunk_ids(docs)


def document_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.expr(FILES["filename"]).alias("filename"), F.expr(FILES["path"]).alias("path")).agg(F.min(F.expr(NUMBER)).alias("doc_number"))


DOCUMENTS_SQL = f"(SELECT filename, path, min(doc_number) AS doc_number FROM {CHUNKS_SQL} GROUP BY ALL)"

#: A text with a table of contents, page numbers, short lines and loose spacing.
MESSY = "'TABLE OF CONTENTS\nSECTION 1: Scope ..... 3\nA. Things 4\nCHAPTER one\n' || replace(text, '. ', ' .\n 12\n\n\n\n\nab\n\tPage 2 of 9\nthe  rest ,')"
HEADS = ["CHAPTER 3", "SECTION 2: Part", "1. GENERAL TERMS", "1.2. Scope", "1.2.3. Detail", "a. item", "(4) point"]


def messy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(MESSY.replace("\n", "\\n").replace("\t", "\\t")).alias("text"))


MESSY_SQL = f"(SELECT doc_id, {MESSY} AS text FROM documents)"

#: A text whose lines are items of a list, so that none is a heading.
LISTED = "'- ' || replace(text, '\n', '\n- ')"
LISTED_SQL = f"(SELECT doc_id, {LISTED} AS text FROM documents)"


def listed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(LISTED.replace("\n", "\\n")).alias("text"))


def outline(spark: SparkSession, sf: str) -> DataFrame:
    """Lines: each sentence one, and a heading before every fifth, of a level that its number gives."""
    lines = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n")
    heads = F.array(*[F.lit(h) for h in HEADS])
    shaped = F.transform(lines, lambda x, i: F.when(i % 5 == 2, F.concat(F.get(heads, ((i * i + F.col("doc_id")) % 7).cast("int")), F.lit("\n"), x)).otherwise(x))
    return table(spark, sf, "documents").select("doc_id", F.array_join(shaped, "\n").alias("text"))


HEADS_SQL = "[" + ", ".join(f"'{h}'" for h in HEADS) + "]"
OUTLINE_SQL = rf"""(SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN (i - 1) % 5 = 2 THEN {HEADS_SQL}[(((i - 1) * (i - 1) + doc_id) % 7)::INT + 1] || chr(10) || x ELSE x END), chr(10)) AS text
  FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS l FROM documents))"""


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words_sql(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^\s]+'))::INT"


# --- scalar functions -----------------------------------------------------------------------------


@query(f"SELECT doc_id, {words_sql('text')} AS n_words FROM documents")
def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(rf"SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


@query(f"SELECT doc_id, greatest(floor({words_sql('text')} * 1.3::DOUBLE), floor(length(text) / 4.0))::INT AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


NAMES = [
    "CASE doc_id % 6 WHEN 0 THEN '500085p.pdf' WHEN 1 THEN 'DODI ' || doc_id || '.85.txt' WHEN 2 THEN 'dodm_4140.01.txt' WHEN 3 THEN '1' || lpad(cast(doc_id % 1000000 as string), 6, '0') || '.PDF' ELSE 'notes' || doc_id || '.txt' END",
    "CASE WHEN doc_id % 6 = 4 THEN 'see number  ' || doc_id || '.56 and DODD 1.2' WHEN doc_id % 12 = 5 THEN 'DODD-' || doc_id || '.7' ELSE text END",
]


@query(rf"""SELECT doc_id, coalesce(
  CASE WHEN regexp_matches(f, '(?i)(\d{{4}})(\d{{2}})p?\.pdf$') THEN regexp_extract(f, '(?i)(\d{{4}})(\d{{2}})p?\.pdf$', 1) || '.' || regexp_extract(f, '(?i)(\d{{4}})(\d{{2}})p?\.pdf$', 2) END,
  nullif(regexp_extract(f, '(?i)DOD[IDM][\s_-]?(\d+\.\d+)', 1), ''), nullif(regexp_extract(p, '(?i)NUMBER\s+(\d+\.\d+)', 1), ''), nullif(regexp_extract(p, '(?i)DOD[IDM][\s_-]?(\d+\.\d+)', 1), '')) AS number
  FROM (SELECT doc_id, {NAMES[0].replace('string', 'varchar')} AS f, {NAMES[1]} AS p FROM documents)""")
def extract_doc_number(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.expr(NAMES[0]).alias("f"), F.expr(NAMES[1]).alias("p"))
    return rows.select("doc_id", T.document_number(F.col("f"), None, F.col("p")).alias("number"))


TOC_SQL = " OR ".join(f"regexp_matches({{x}}, '{p}')" for p in (r"\.{{3,}}", r"\s+\d+$", r"\.{{2,}}\s*\d+", r"^\d+\.\d+\..*\d+$", r"^[A-Z]\.\s+.*\d+$"))


def toc_sql(x: str) -> str:
    return f"({x} <> '' AND ({TOC_SQL.format(x=x)}))"


LINES_SQL = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {of}))"


@query(f"SELECT doc_id, line, {toc_sql(strip_sql('text'))} AS is_toc FROM {LINES_SQL.format(of=MESSY_SQL)}")
def toc_line_predicate(spark: SparkSession, sf: str) -> DataFrame:
    lines = structure.lines(messy(spark, sf))
    return lines.select(F.col("doc").alias("doc_id"), F.col("line").cast("long").alias("line"), T.is_toc_line(T.strip(F.col("text"))).alias("is_toc"))


ENDS_SQL = "regexp_matches(b, '^(SECTION 1:|1\\.|CHAPTER|PART|APPENDIX)|GENERAL ISSUANCE INFORMATION')"
def removed_sql(of: str) -> str:
    return f"""(WITH l AS (SELECT doc_id, line, text, {strip_sql('text')} AS b FROM {LINES_SQL.format(of=of)}),
  t AS (SELECT doc_id, min(line) AS title FROM l WHERE contains(upper(b), 'TABLE OF CONTENTS') GROUP BY ALL),
  e AS (SELECT doc_id, min(line) AS stop FROM l JOIN t USING (doc_id) WHERE line > title AND {ENDS_SQL} AND NOT contains(upper(b), 'TABLE OF CONTENTS') GROUP BY ALL)
  SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (line >= coalesce(stop, 0) AND NOT {toc_sql('b')}), '') AS text FROM l LEFT JOIN e USING (doc_id) GROUP BY doc_id)"""


@query(f"SELECT doc_id, text AS value FROM {removed_sql(MESSY_SQL)}")
def toc_removal(spark: SparkSession, sf: str) -> DataFrame:
    return messy(spark, sf).select("doc_id", T.remove_toc(F.col("text")).alias("value"))


def spaced_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+([.,;:!?])', '\1', 'g'), '([.!?])\s*([a-z])', '\1 \2', 'g')"


def clean_sql(of: str) -> str:
    x = "text"
    for pattern, by in ((r"[ \t]+", "' '"), (r"\n{4,}", "repeat(chr(10), 3)"), (r"[\f\r\v]", "''"), (r"\n\s*\d{1,4}\s*\n", "chr(10)"), (r"(?i)\n\s*Page \d+ of \d+\s*\n", "chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    b = strip_sql("x")
    keep = f"length({b}) > 2 OR regexp_matches(upper({b}), 'SECTION|CHAPTER|PART|DODD|DODI|APPENDIX|TABLE') OR regexp_matches({b}, '^[A-Z0-9]+[.:]\\s*[A-Z]') OR starts_with({b}, '===')"
    lines = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda x: {keep}), chr(10))"
    return f"SELECT doc_id, {strip_sql(spaced_sql(lines))} AS value FROM {removed_sql(of)}"


@query(clean_sql(MESSY_SQL))
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return messy(spark, sf).select("doc_id", T.clean(F.col("text")).alias("value"))


def final_sql(x: str) -> str:
    return strip_sql(spaced_sql(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', repeat(chr(10), 2), 'g')"))


@query(f"SELECT doc_id, {final_sql('text')} AS value FROM {MESSY_SQL}")
def final_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return messy(spark, sf).select("doc_id", T.final_cleanup(F.col("text")).alias("value"))


LINKED = "replace(replace(text, '. ', ' , see https://www.example.com/a.b?c=d;e .and '), ', ', ' http://x.org ;')"
LINK_SQL = r"""https?://[^\s<>"{}|\\^`\[\]]+[^\s<>"{}|\\^`\[\].,;!?)]"""


@query(f"""SELECT doc_id, array_to_string(list_transform(p, lambda x, i: x || coalesce(u[i], '')), '') AS value
  FROM (SELECT doc_id, string_split({spaced_sql(f"regexp_replace(text, '{LINK_SQL}', chr(1), 'g')")}, chr(1)) AS p, regexp_extract_all(text, '{LINK_SQL}') AS u FROM (SELECT doc_id, {LINKED} AS text FROM documents))""")
def ocr_fix_urls(spark: SparkSession, sf: str) -> DataFrame:
    with_urls = table(spark, sf, "documents").select("doc_id", F.expr(LINKED).alias("text"))
    return with_urls.select("doc_id", T.fix_spacing(F.col("text")).alias("value"))


def _truncated_sql() -> str:
    cut = "substr(text, 1, greatest(2048 - length(q) - 20, 0))"
    period, space = (f"(CASE WHEN strpos(reverse({cut}), '{m}') > 0 THEN length({cut}) - strpos(reverse({cut}), '{m}') ELSE -1 END)" for m in (".", " "))
    room = "(2048 - length(q) - 20)"
    return f"""SELECT doc_id, CASE WHEN length(q) + length(text) <= 2048 THEN text WHEN {room} < 100 THEN substr(text, 1, 100)
  WHEN {period} > {room} * 0.8::DOUBLE THEN substr({cut}, 1, {period} + 1) WHEN {space} > {room} * 0.9::DOUBLE THEN substr({cut}, 1, {space}) ELSE {cut} END AS value
  FROM (SELECT doc_id, text, repeat('why ', (doc_id % 520)::INT) AS q FROM documents)"""


@query(_truncated_sql())
def truncate_pair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "text", F.expr("repeat('why ', cast(doc_id % 520 as int))").alias("q"))
    return rows.select("doc_id", T.truncate_pair(F.col("q"), F.col("text")).alias("value"))


@query(f"""SELECT doc_id, n AS number, {', '.join(f"CASE WHEN length(split_part(n, '.', 1)) >= {k} THEN try_cast(substr(split_part(n, '.', 1), 1, {k}) AS INT) * {m} END AS {name}" for k, m, name in ((1, 1000, 'major'), (2, 100, 'subgroup'), (3, 10, 'range')))}
  FROM (SELECT doc_id, substr({NUMBER_SQL}, 1 + (doc_id % 5)::INT) AS n FROM documents)""")
def doc_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.expr(f"substr({NUMBER}, 1 + cast(doc_id % 5 as int))").alias("number"))
    return rows.select("doc_id", "number", *[T.taxonomy(F.col("number"), k).alias(name) for k, name in ((1, "major"), (2, "subgroup"), (3, "range"))])


@query(f"SELECT doc_id, chunk_id FROM {CHUNKS_SQL}")
def chunk_id(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_table(spark, sf).select("doc_id", "chunk_id")


@query("SELECT DISTINCT 'chunks_' || translate('org/' || lang || '-' || source, '/-', '__') AS name FROM documents")
def collection_name(spark: SparkSession, sf: str) -> DataFrame:
    model = F.concat(F.lit("org/"), "lang", F.lit("-"), "source")
    return table(spark, sf, "documents").select(T.collection_name(model).alias("name")).distinct()


CELLS = "array(array(cast(doc_id as string), null, ' a\nb ', ''), array(cast(null as string), ' '), array(source, lang))"


@query("""SELECT doc_id, '=== TABLE 3.' || (doc_id % 4 + 1) || ' START ===' || chr(10) || doc_id || ' || a | b' || chr(10) || concat_ws(' || ', nullif(trim(source), ''), nullif(trim(lang), '')) || chr(10) || '=== TABLE 3.' || (doc_id % 4 + 1) || ' END ===' AS value FROM documents""")
def format_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.expr(CELLS.replace("\n", "\\n")).alias("cells"))
    return rows.select("doc_id", T.format_table(F.col("cells"), F.lit(3), F.col("doc_id") % 4 + 1).alias("value"))


BAD = "text || CASE doc_id % 3 WHEN 0 THEN '<b>|' ELSE '' END"


@query(rf"""SELECT doc_id, CASE WHEN length(t) > 1000 THEN 'Input too long (max 1000 characters)'
  WHEN len(b) > 0 THEN 'Invalid characters not allowed: ''' || array_to_string(b, ''', ''') || '''. Please remove these characters and try again.' END AS error
  FROM (SELECT doc_id, t, list_filter(regexp_extract_all(t, '[|`$\{{\}}\[\]<>\\]'), lambda x, i: list_position(regexp_extract_all(t, '[|`$\{{\}}\[\]<>\\]'), x) = i) AS b FROM (SELECT doc_id, {BAD} AS t FROM documents))""")
def validate_input(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.input_error(F.expr(BAD)).alias("error"))


ASKED = "CASE WHEN vec_id % 4 = 0 THEN '  ' ELSE 'why ' || vec_id END"


@query(f"""SELECT vec_id, CASE WHEN trim(q) = '' THEN 'Please provide a valid question.' WHEN vec_id % 7 = 0 THEN 'Please load documents first using load_documents()'
  WHEN vec_id % 5 = 0 THEN 'Simple response for: ''' || q || ''' (no context retrieval)' WHEN label = 0 THEN 'No relevant policy information found for: ''' || q || ''''
  WHEN label = 1 THEN 'Context chunks too large for available token space' END AS message FROM (SELECT *, {ASKED} AS q FROM embeddings)""")
def query_guards(spark: SparkSession, sf: str) -> DataFrame:
    n_hits = F.when(F.col("label") == 1, -1).otherwise(F.col("label"))
    state = context.status(F.expr(ASKED), F.col("vec_id") % 7 != 0, F.col("vec_id") % 5 != 0, n_hits)
    return table(spark, sf, "embeddings").select("vec_id", context.message(state, F.expr(ASKED)).alias("message"))


def _recommend_sql() -> str:
    tier = "CASE " + " ".join(f"WHEN gb >= {g} THEN {t}" for t, g in reversed(TIER_FROM_GB)) + " ELSE 0 END"
    model = "CASE tier " + " ".join(f"WHEN {m[1]} THEN '{m[0]}'" for m in LLM_MODELS) + " END"
    emb = "CASE " + " ".join(f"WHEN gb >= {g} THEN '{m}'" for m, g in reversed(EMBEDDING_FROM_GB)) + " END"
    return f"SELECT c_custkey, tier, {model} AS model, {emb} AS embedding_model FROM (SELECT *, {tier} AS tier FROM (SELECT c_custkey, (c_custkey % 20)::DOUBLE AS gb FROM customer))"


@query(_recommend_sql())
def recommend_model(spark: SparkSession, sf: str) -> DataFrame:
    """Memory to tier (a range join on two tiny catalogs); a tier without a model would fall to the one below."""
    machines = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 20).cast("double").alias("gb"))
    catalog = tiers(spark).join(llm_models(spark).select(F.col("tier").alias("has"), "model"), F.col("has") <= F.col("tier")).groupBy("tier", "from_gb", "to_gb").agg(F.max_by("model", "has").alias("model"))
    emb = embedding_models(spark).select(F.col("model").alias("embedding_model"), F.col("from_gb").alias("e0"), F.col("to_gb").alias("e1"))
    found = machines.join(F.broadcast(catalog), (F.col("gb") >= F.col("from_gb")) & (F.col("gb") < F.col("to_gb"))).join(F.broadcast(emb), (F.col("gb") >= F.col("e0")) & (F.col("gb") < F.col("e1")))
    return found.select("c_custkey", "tier", "model", "embedding_model")


@query("SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS folder FROM pages WHERE url IS NOT NULL")
def root_folders(spark: SparkSession, sf: str) -> DataFrame:
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    return table(spark, sf, "pages").filter("url is not null").select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("folder")).distinct()


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names}))"


@query("SELECT model, tier, max_tokens, temperature::DOUBLE AS temperature, top_p::DOUBLE AS top_p, prompt_style, context_window FROM " + _values(LLM_MODELS, "model, tier, max_tokens, temperature, top_p, prompt_style, context_window"))
def model_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return llm_models(spark).orderBy("tier")


def prompt_sql(style: str, ctx: str, q: str) -> str:
    text = PROMPTS[style].replace("'", "''")
    return f"replace(replace('{text}', '{{question}}', {q}), '{{context}}', {ctx})"


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {prompt_sql('simple', 'text', 'lang')} WHEN 1 THEN {prompt_sql('instruct', 'text', 'lang')} WHEN 2 THEN {prompt_sql('mistral', 'text', 'lang')} ELSE {prompt_sql('fallback', 'text', 'lang')} END AS prompt FROM documents")
def render_prompt(spark: SparkSession, sf: str) -> DataFrame:
    style = F.get(F.array(*[F.lit(x) for x in ("simple", "instruct", "mistral", "no such style")]), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf, "documents").select("doc_id", context.prompt(F.col("text"), F.col("lang"), style).alias("prompt"))


@query(f"""SELECT doc_id, 'Based on DOD policies: ' || {strip_sql("CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^" + chr(92) + "s+', '') ELSE text END")} || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'Sources: ' || lang || ', ' || source END AS answer FROM documents""")
def format_answer(spark: SparkSession, sf: str) -> DataFrame:
    lead = F.when(F.col("doc_id") % 2 == 0, F.lit(context.LEAD_INS[1] + "  ")).otherwise("")
    cited = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    return table(spark, sf, "documents").select("doc_id", context.formatted(F.concat(lead, "text"), cited).alias("answer"))


@query("SELECT doc_id, 'Based on DOD policies, here''s what I found regarding ''' || lang || ''':' || chr(10) || chr(10) || 'Relevant policy excerpt:' || chr(10) || substr(text, 1, 200) || '...' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Note: LLM not available, showing simplified response.' ELSE '' END || chr(10) || chr(10) || 'Found ' || n_chars || ' relevant policy sections.' AS answer FROM documents")
def fallback_answer(spark: SparkSession, sf: str) -> DataFrame:
    both = [context.excerpt(F.col("text"), F.col("lang"), F.col("n_chars"), note=note) for note in (True, False)]
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, both[0]).otherwise(both[1]).alias("answer"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview FROM documents")
def context_preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", context.preview(F.col("text")).alias("preview"))


# --- structure ------------------------------------------------------------------------------------

KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(b, '(?i){h[1].replace(T.W, chr(92) + 's').replace(T.W[1:-1], chr(92) + 's')}') THEN {k}" for k, h in enumerate(structure.HEADINGS)) + " END"


def field_sql(i: int) -> str:
    return "[" + ", ".join(repr(h[i]) for h in structure.HEADINGS) + "][k + 1]"


def heads_sql(of: str = OUTLINE_SQL) -> str:
    return f"(SELECT doc_id, line, text, b, k, {field_sql(0)} AS name, {field_sql(2)} AS level, {field_sql(3)} AS priority FROM (SELECT *, {KIND_SQL} AS k FROM (SELECT *, {strip_sql('text')} AS b FROM {LINES_SQL.format(of=of)})))"


@query(f"SELECT doc_id, line, b AS header, name, level, priority FROM {heads_sql()} WHERE k IS NOT NULL")
def classify_headings(spark: SparkSession, sf: str) -> DataFrame:
    found = structure.headings(structure.lines(outline(spark, sf))).filter("level is not null")
    return found.select(F.col("doc").alias("doc_id"), F.col("line").cast("long").alias("line"), F.col("bare").alias("header"), "name", "level", "priority")


# In SQL the tree is found by comparing every two headings of a document, not by windows.
SECTIONS_SQL = f"""(WITH l AS MATERIALIZED (SELECT *, {words_sql('b')} AS w, sum((k IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS sec, count(*) OVER (PARTITION BY doc_id) AS n_lines FROM {heads_sql()}),
  h AS MATERIALIZED (SELECT doc_id, sec::INT AS idx, line, b AS header, name, level, priority, n_lines FROM l WHERE k IS NOT NULL),
  up AS (SELECT a.doc_id, a.idx, max(b.idx) AS parent FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.line < a.line AND b.level < a.level GROUP BY ALL),
  dn AS (SELECT a.doc_id, a.idx, min(b.line) AS stop, min(b.idx) AS next_idx FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.line > a.line AND b.level <= a.level GROUP BY ALL),
  own AS (SELECT doc_id, sec AS idx, sum(w) AS words FROM l WHERE sec >= 0 GROUP BY ALL),
  cnt AS (SELECT doc_id, max(idx) + 1 AS n FROM h GROUP BY ALL),
  s AS (SELECT h.*, parent, line + 1 AS content_start, coalesce(stop, n_lines) AS content_end, coalesce(next_idx, n) AS next_idx, words FROM h LEFT JOIN up USING (doc_id, idx) LEFT JOIN dn USING (doc_id, idx) JOIN own USING (doc_id, idx) JOIN cnt USING (doc_id))
  SELECT s.*, EXISTS (SELECT 1 FROM l WHERE l.doc_id = s.doc_id AND l.line >= content_start AND l.line < content_end AND l.k IS NULL AND l.b <> '') AS has_content FROM s)"""


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return structure.sections(structure.lines(outline(spark, sf))).withColumnRenamed("doc", "doc_id")


@query(f"SELECT doc_id, idx, line, header, name, level, priority, parent, content_start, content_end, has_content, next_idx, words::INT AS words FROM {SECTIONS_SQL}")
def section_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _sections(spark, sf).select(
        "doc_id", "idx", F.col("line").cast("long").alias("line"), "header", "name", "level", "priority", "parent",
        F.col("content_start").cast("long").alias("content_start"), F.col("content_end").cast("long").alias("content_end"), "has_content", "next_idx", "words")


@query(f"SELECT a.doc_id, a.idx, sum(b.words)::BIGINT AS subtree FROM {SECTIONS_SQL} a JOIN {SECTIONS_SQL} b ON a.doc_id = b.doc_id AND b.idx >= a.idx AND b.idx < a.next_idx GROUP BY ALL")
def subtree_words(spark: SparkSession, sf: str) -> DataFrame:
    found = structure.subtree_words(structure.sections(structure.lines(outline(spark, sf))))
    return found.select(F.col("doc").alias("doc_id"), "idx", "subtree")


@query(f"SELECT doc_id, sec::INT AS idx, max(b) FILTER (k IS NOT NULL) AS header, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (k IS NULL), '') AS content FROM (SELECT *, sum((k IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS sec FROM {heads_sql()}) GROUP BY ALL")
def section_content(spark: SparkSession, sf: str) -> DataFrame:
    return structure.section_content(structure.lines(outline(spark, sf))).withColumnRenamed("doc", "doc_id")


@query(f"SELECT doc_id, level, count(*) AS n, array_to_string(list(idx ORDER BY idx), ',') AS indexes FROM {SECTIONS_SQL} GROUP BY ALL")
def sections_by_level(spark: SparkSession, sf: str) -> DataFrame:
    found = structure.sections_by_level(structure.sections(structure.lines(outline(spark, sf))))
    return found.select(F.col("doc").alias("doc_id"), "level", "n", F.array_join(F.col("indexes").cast("array<string>"), ",").alias("indexes"))


MARKED = "replace(replace(text, '. The', '.\n=== TABLE 1.1 START ===\nThe'), ', ', '\n=== TABLE 1.1 END ===\n\n')"


@query(f"""WITH m AS (SELECT doc_id, line, text, contains(text, 'START ===') AS s, lag(contains(text, 'START ===')) OVER w AS ps, lag(line) OVER w AS pl, lag(text) OVER w AS pt
  FROM {LINES_SQL.format(of=f"(SELECT doc_id, {MARKED} AS text FROM documents)")} WHERE contains(text, '=== TABLE') WINDOW w AS (PARTITION BY doc_id ORDER BY line))
  SELECT doc_id, pl AS start_line, trim(pt) AS name, line AS end_line FROM m WHERE NOT s AND ps""")
def table_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.expr(MARKED.replace("\n", "\\n")).alias("text"))
    found = structure.table_spans(structure.lines(docs))
    return found.select(F.col("doc").alias("doc_id"), F.col("start_line").cast("long").alias("start_line"), "name", F.col("end_line").cast("long").alias("end_line"))


@query(f"""SELECT doc_id, min(line) AS start_line, max(line) AS end_line FROM (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island
  FROM {LINES_SQL.format(of=f"(SELECT doc_id, {MARKED} AS text FROM documents)")} WHERE {strip_sql('text')} <> '') GROUP BY doc_id, island""")
def paragraph_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.expr(MARKED.replace("\n", "\\n")).alias("text"))
    found = structure.paragraph_spans(structure.lines(docs))
    return found.select(F.col("doc").alias("doc_id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


# --- chunks ---------------------------------------------------------------------------------------

# The folds as recursive SQL: one step a part, for all documents at once. {parts} gives (doc_id, i, p, n), i from 1.
FOLD_SQL = """fold AS (SELECT DISTINCT doc_id, 0 AS i, []::VARCHAR[] AS done, '' AS cur, 0 AS n FROM {parts}
  UNION ALL SELECT f.doc_id, x.i, {done}, {cur}, {n} FROM fold f JOIN {parts} x ON f.doc_id = x.doc_id AND x.i = f.i + 1),
  folded AS (SELECT doc_id, CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END AS chunks FROM fold f WHERE i = (SELECT max(i) FROM {parts} x WHERE x.doc_id = f.doc_id))"""
EACH_SQL = "SELECT doc_id, generate_subscripts(chunks, 1)::INT - 1 AS chunk_index, unnest(chunks) AS chunk_text FROM folded"
LINE_PARTS = f"parts AS MATERIALIZED (SELECT doc_id, i, p, {words_sql('p')} AS n FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
FITS = "((f.n < 150 OR x.n < 150) AND f.n + x.n <= 400)"
MERGED = FOLD_SQL.format(
    parts="parts", done=f"CASE WHEN f.n = 0 OR {FITS} THEN f.done ELSE list_append(f.done, f.cur) END",
    cur=f"CASE WHEN f.n = 0 THEN x.p WHEN {FITS} THEN f.cur || repeat(chr(10), 2) || x.p ELSE x.p END", n=f"CASE WHEN f.n > 0 AND {FITS} THEN f.n + x.n ELSE x.n END")
MERGE_SQL = f"WITH RECURSIVE {LINE_PARTS}, {MERGED} {EACH_SQL}"
#: Sentences (doc_id, s, sentence, n), and the cuts of those of {{least}} words or more.
SENTENCES_SQL = rf"sent AS MATERIALIZED (SELECT doc_id, s, sentence, {words_sql('sentence')} AS n FROM (SELECT doc_id, generate_subscripts(l, 1) AS s, unnest(l) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM {{of}})))"
CUTS_SQL = r"""w AS MATERIALIZED (SELECT doc_id, s, generate_subscripts(l, 1) AS k, unnest(l) AS word, len(l) AS total FROM (SELECT doc_id, s, regexp_extract_all(sentence, '[^\s]+') AS l FROM sent WHERE n > {least})),
  stops AS MATERIALIZED (SELECT doc_id, s, k FROM w WHERE regexp_matches(word, '[.!?;,]$')),
  cuts AS (SELECT DISTINCT doc_id, s, 0 AS a, 0 AS b, total FROM w
    UNION ALL SELECT c.doc_id, c.s, c.b, least(c.total, coalesce((SELECT min(k) FROM stops t WHERE t.doc_id = c.doc_id AND t.s = c.s AND k >= c.b + 300 AND k <= c.b + 449), c.b + 400)), c.total FROM cuts c WHERE c.b < c.total),
  pieces AS MATERIALIZED (SELECT c.doc_id, c.s, c.a, string_agg(w.word, ' ' ORDER BY w.k) AS p FROM cuts c JOIN w ON w.doc_id = c.doc_id AND w.s = c.s AND w.k > c.a AND w.k <= c.b GROUP BY ALL)"""
PUNCT_SQL = f"WITH RECURSIVE sent AS MATERIALIZED (SELECT doc_id, 1 AS s, text AS sentence, {words_sql('text')} AS n FROM documents), {CUTS_SQL.format(least=0)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a)::INT - 1 AS chunk_index, p AS chunk_text FROM pieces"
LONG = "x.long IS NOT NULL"
FLUSHED = "CASE WHEN f.cur <> '' THEN list_append(f.done, f.cur) ELSE f.done END"
PACK_FOLD = FOLD_SQL.format(
    parts="parts", done=f"CASE WHEN {LONG} THEN list_concat({FLUSHED}, x.long) WHEN f.n + x.n <= 300 THEN f.done ELSE {FLUSHED} END",
    cur=f"CASE WHEN {LONG} THEN '' WHEN f.n + x.n <= 300 AND f.cur <> '' THEN f.cur || ' ' || x.p ELSE x.p END", n=f"CASE WHEN {LONG} THEN 0 WHEN f.n + x.n <= 300 THEN f.n + x.n ELSE x.n END")
PACKED = f"{SENTENCES_SQL.format(of='documents')}, {CUTS_SQL.format(least=400)}, parts AS MATERIALIZED (SELECT doc_id, s AS i, sentence AS p, n, (SELECT list(p ORDER BY a) FROM pieces z WHERE z.doc_id = sent.doc_id AND z.s = sent.s) AS long FROM sent), {PACK_FOLD}"
PACK_SQL = f"WITH RECURSIVE {PACKED} {EACH_SQL}"
#: All chunks of cleaned documents, which have neither blank lines nor headings: one if short, else packed sentences.
CHUNKED_SQL = f"""(WITH RECURSIVE clean AS MATERIALIZED ({clean_sql(LISTED_SQL)}), {PACKED.replace(SENTENCES_SQL.format(of='documents'), SENTENCES_SQL.format(of='(SELECT doc_id, value AS text FROM clean)'))}
  SELECT * FROM ({EACH_SQL}) WHERE doc_id IN (SELECT doc_id FROM clean WHERE {words_sql('value')} > 400)
  UNION ALL SELECT doc_id, 0, {final_sql('value')} FROM clean WHERE {words_sql('value')} BETWEEN 1 AND 400)"""
# The documents have no blank lines, so each is one paragraph.
FALLBACK_SQL = f"WITH RECURSIVE {PACKED} SELECT * FROM ({EACH_SQL}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE {words_sql('text')} > 400) UNION ALL SELECT doc_id, 0, {strip_sql('text')} FROM documents WHERE {words_sql('text')} BETWEEN 1 AND 400"


def _overlap_sql(a: str, b: str) -> str:
    """The last whole sentences of a that fit in 26 words together, else words of a or b."""
    s = rf"list_filter(list_transform(string_split(regexp_replace({strip_sql(a)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip_sql('s')}), lambda s: s <> '')"
    w = lambda x: rf"regexp_extract_all({x}, '[^\s]+')"
    keep = rf"list_filter({s}, lambda s, i: len(regexp_extract_all(array_to_string(list_slice({s}, i, len({s})), ' '), '[^\s]+')) <= 26)"
    return f"CASE WHEN len({keep}) > 0 THEN array_to_string({keep}, ' ') WHEN len({w(a)}) >= 26 THEN array_to_string(list_slice({w(a)}, -26, -1), ' ') WHEN len({w(b)}) >= 26 THEN array_to_string(list_slice({w(b)}, 1, 26), ' ') ELSE '' END"


OVERLAPPED_SQL = f"""SELECT doc_id, chunk_index, CASE WHEN chunk_index > 0 AND o <> '' THEN o || ' ' || p ELSE p END AS chunk_text FROM (SELECT doc_id, chunk_index, p, {_overlap_sql('q', 'p')} AS o
  FROM (SELECT doc_id, i::INT - 1 AS chunk_index, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY i), '') AS q FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))"""


@query(f"SELECT doc_id, chunk_index, chunk_text FROM {CHUNKED_SQL}")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.explode_chunks(chunking.chunk_documents(listed(spark, sf))).withColumnRenamed("doc", "doc_id")


def _runs_sql() -> str:
    """Runs of sections by a recursion from one run's end to the next; the lines before the first heading come first."""
    return f"""WITH RECURSIVE hl AS MATERIALIZED (SELECT *, sum((k IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS sec FROM {heads_sql()}),
  sec AS MATERIALIZED (SELECT *, (sum(words) OVER (PARTITION BY doc_id ORDER BY idx) - words) AS before FROM {SECTIONS_SQL}),
  txt AS (SELECT doc_id, sec::INT AS idx, max(b) FILTER (k IS NOT NULL) AS header, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (k IS NULL), '') AS content FROM hl GROUP BY ALL),
  sub AS (SELECT a.doc_id, a.idx, sum(b.words) AS subtree FROM sec a JOIN sec b ON a.doc_id = b.doc_id AND b.idx >= a.idx AND b.idx < a.next_idx GROUP BY ALL),
  stops AS MATERIALIZED (SELECT s.doc_id, s.idx, coalesce((SELECT max(c.next_idx) FROM sec c JOIN sub z USING (doc_id, idx) WHERE c.doc_id = s.doc_id AND c.parent = s.idx AND c.before + z.subtree - s.before <= 400), s.idx + 1) AS stop FROM sec s),
  runs AS (SELECT doc_id, idx, stop, 0 AS n FROM stops WHERE idx = 0 UNION ALL SELECT s.doc_id, s.idx, s.stop, r.n + 1 FROM runs r JOIN stops s ON s.doc_id = r.doc_id AND s.idx = r.stop),
  pre AS (SELECT doc_id, content FROM txt WHERE idx = -1 AND {strip_sql('content')} <> '' AND doc_id IN (SELECT doc_id FROM sec)),
  body AS (SELECT r.doc_id, r.n, string_agg(CASE WHEN {strip_sql('t.content')} <> '' THEN t.header || chr(10) || t.content ELSE t.header END, chr(10) ORDER BY t.idx) AS chunk_text FROM runs r JOIN txt t ON t.doc_id = r.doc_id AND t.idx >= r.idx AND t.idx < r.stop GROUP BY ALL)
  SELECT doc_id, 0 AS chunk_index, content AS chunk_text FROM pre
  UNION ALL SELECT doc_id, (n + (doc_id IN (SELECT doc_id FROM pre))::INT)::INT, chunk_text FROM body"""


@query(_runs_sql())
def hierarchical_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return outline(spark, sf).select("doc_id", F.posexplode(chunking.hierarchical_chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


@query(FALLBACK_SQL)
def fallback_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.fallback_chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


@query(PACK_SQL)
def sentence_pack(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.pack_sentences(F.col("text"))).alias("chunk_index", "chunk_text"))


@query()
def table_aware_split(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.expr(MARKED.replace("\n", "\\n"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.table_aware_split(marked)).alias("chunk_index", "chunk_text"))


@query(PUNCT_SQL)
def punct_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.split_at_punctuation(F.col("text"))).alias("chunk_index", "chunk_text"))


def _lines_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("parts"))


@query(MERGE_SQL)
def merge_small(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_of(spark, sf).select("doc_id", F.posexplode(chunking.merge_small(F.col("parts"))).alias("chunk_index", "chunk_text"))


@query(OVERLAPPED_SQL)
def apply_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_of(spark, sf).select("doc_id", F.posexplode(chunking.apply_overlap(F.col("parts"))).alias("chunk_index", "chunk_text"))


@query(f"SELECT doc_id, {_overlap_sql('text', 'reverse(text)')} AS overlap FROM documents")
def overlap_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", chunking.overlap_text(F.col("text"), F.reverse("text")).alias("overlap"))


def _capped_sql() -> str:
    """Texts of over 400 words: sentences packed to 270; where that leaves a larger one, parts that end in a mark; what is still larger by 400 words."""
    over = "f.n + x.n > 270"
    fold = FOLD_SQL.format(
        parts="{parts}", done=f"CASE WHEN {over} AND f.cur <> '' THEN list_append(f.done, f.cur) ELSE f.done END",
        cur=f"CASE WHEN {over} OR f.cur = '' THEN x.p ELSE f.cur || ' ' || x.p END", n=f"CASE WHEN {over} THEN x.n ELSE f.n + x.n END")
    named = lambda name: fold.format(parts=f"{name}_parts").replace("folded AS", f"{name}_folded AS").replace("fold AS", f"{name}_fold AS").replace("FROM fold f", f"FROM {name}_fold f")
    split = lambda name, marks, of: rf"{name}_parts AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, p, {words_sql('p')} AS n FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS p FROM (SELECT doc_id, string_split(regexp_replace(text, '{marks}', '\1' || chr(1), 'g'), chr(1)) AS l FROM {of})) WHERE '{name}' = 'sen' OR p <> '')"
    each = lambda name: f"(SELECT doc_id, generate_subscripts(chunks, 1) AS i, unnest(chunks) AS p FROM {name}_folded)"
    trimmed = lambda name: f"(SELECT doc_id, i, {strip_sql('p')} AS p FROM {each(name)})"
    w = r"regexp_extract_all(p, '[^\s]+')"
    return rf"""WITH RECURSIVE big AS MATERIALIZED (SELECT doc_id, text FROM documents WHERE {words_sql('text')} > 400),
  {split('sen', r'([.!?])\s+', 'big')}, {named('sen')},
  good AS MATERIALIZED (SELECT doc_id FROM {trimmed('sen')} GROUP BY doc_id HAVING max({words_sql('p')}) <= 400 AND doc_id IN (SELECT doc_id FROM big WHERE regexp_matches(text, '[.!?]\s'))),
  rest AS MATERIALIZED (SELECT * FROM big WHERE doc_id NOT IN (SELECT doc_id FROM good)),
  {split('mark', r'([.!?;:,])\s*', 'rest')}, {named('mark')},
  cut AS (SELECT doc_id, i, p, generate_series AS j FROM {trimmed('mark')}, generate_series(0, 1000) WHERE p <> '' AND generate_series < CASE WHEN {words_sql('p')} > 400 THEN ceil({words_sql('p')} / 400.0) ELSE 1 END),
  found AS (SELECT doc_id, i, 0 AS j, p FROM {trimmed('sen')} WHERE doc_id IN (SELECT doc_id FROM good) AND p <> ''
    UNION ALL SELECT doc_id, i, j, CASE WHEN {words_sql('p')} > 400 THEN array_to_string(list_slice({w}, j * 400 + 1, (j + 1) * 400), ' ') ELSE p END FROM cut
    UNION ALL SELECT doc_id, 1, 0, text FROM documents WHERE {words_sql('text')} <= 400)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS chunk_index, p AS chunk_text FROM found"""


@query(_capped_sql())
def enforce_size(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.enforce_size(F.array("text"))).alias("chunk_index", "chunk_text"))


@query("SELECT doc_id, NOT list_has_any(list_filter([doc_id % 3, doc_id % 5], lambda x: x <= 2), list_filter([doc_id % 4, doc_id % 2], lambda x: x <= 2)) AND len(list_filter([doc_id % 3, doc_id % 5], lambda x: x <= 2)) > 0 AND len(list_filter([doc_id % 4, doc_id % 2], lambda x: x <= 2)) > 0 AS crosses FROM documents")
def boundary_check(spark: SparkSession, sf: str) -> DataFrame:
    """Sections whose number is their level."""
    a, b = F.expr("array(doc_id % 3, doc_id % 5)"), F.expr("array(doc_id % 4, doc_id % 2)")
    return table(spark, sf, "documents").select("doc_id", chunking.crosses_boundary(a, a, b, b).alias("crosses"))


@query(f"SELECT count(*) AS n_chunks, round(avg({words_sql('chunk_text')}), 6) AS avg_words, count(*) FILTER ({words_sql('chunk_text')} > 400) AS n_over, count(*) FILTER ({words_sql('chunk_text')} < 150) AS n_under FROM {CHUNKED_SQL}")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_stats(chunk_documents(spark, sf)).withColumn("avg_words", F.round("avg_words", 6))


@query("SELECT doc_id, generate_subscripts(l, 1)::INT - 1 AS chunk_index, unnest(l) AS chunk_text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def explode_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("chunks"))
    return chunking.explode_chunks(rows).withColumnRenamed("doc", "doc_id")


# --- store ----------------------------------------------------------------------------------------


@query(f"SELECT c.chunk_id, c.filename, c.path, d.doc_number, c.chunk_index, c.chunk_text FROM {CHUNKS_SQL} c JOIN {DOCUMENTS_SQL} d USING (filename, path)")
def get_all_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return store.all_chunks(document_table(spark, sf), chunk_table(spark, sf))


IDS_SQL = f"(SELECT DISTINCT chunk_id FROM {CHUNKS_SQL} WHERE doc_id % 10 = 3)"


@query(f"SELECT c.chunk_id, c.filename, c.path, d.doc_number, c.chunk_index, c.chunk_text FROM {CHUNKS_SQL} c JOIN {DOCUMENTS_SQL} d USING (filename, path) WHERE c.chunk_id IN (SELECT chunk_id FROM {IDS_SQL})")
def get_chunks_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk_table(spark, sf)
    return store.chunks_by_ids(document_table(spark, sf), chunks, chunks.filter("doc_id % 10 = 3").select("chunk_id").distinct())


MADE = "timestamp '2024-01-02 03:04:05'"


@query(f"SELECT d.*, {MADE.upper()} AS created_at, count(c.doc_id) AS chunk_count FROM (SELECT * FROM {DOCUMENTS_SQL} UNION ALL SELECT 'bare.pdf', '/corpus/bare', NULL) d LEFT JOIN {CHUNKS_SQL} c USING (filename, path) GROUP BY ALL ORDER BY filename, path")
def list_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, one without chunks among them, in the order of the names."""
    bare = spark.createDataFrame([("bare.pdf", "/corpus/bare", None)], "filename string, path string, doc_number string")
    return store.list_documents(document_table(spark, sf).unionByName(bare).withColumn("created_at", F.expr(MADE)), chunk_table(spark, sf))


@query(f"""WITH n AS (SELECT filename, path, min(doc_number) AS doc_number FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'new' || (doc_id % 7) || '.pdf' ELSE filename END AS filename, 'n' || doc_number AS doc_number) FROM {CHUNKS_SQL}) GROUP BY ALL)
  SELECT * FROM {DOCUMENTS_SQL} UNION ALL SELECT * FROM n ANTI JOIN {DOCUMENTS_SQL} d USING (filename, path)""")
def store_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents inserted, or ignored where the store has their file."""
    fresh = chunk_table(spark, sf).select(F.expr("CASE WHEN doc_id % 3 = 0 THEN 'new' || (doc_id % 7) || '.pdf' ELSE filename END").alias("filename"), "path", F.concat(F.lit("n"), "doc_number").alias("doc_number"))
    return store.add_documents(document_table(spark, sf), fresh)


CANDIDATES = "source || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.txt' END"


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(CANDIDATES).alias("filename"), F.expr(FILES["path"]).alias("path"))


@query(f"SELECT doc_id, filename, path FROM (SELECT doc_id, {CANDIDATES} AS filename, '/corpus/' || source AS path FROM documents) c SEMI JOIN {DOCUMENTS_SQL} d USING (filename, path)")
def existing_docs(spark: SparkSession, sf: str) -> DataFrame:
    return store.existing(document_table(spark, sf), _candidates(spark, sf)).select("doc_id", "filename", "path")


@query(f"SELECT doc_id, filename, path FROM (SELECT doc_id, {CANDIDATES} AS filename, '/corpus/' || source AS path FROM documents) c ANTI JOIN {DOCUMENTS_SQL} d USING (filename, path)")
def new_docs(spark: SparkSession, sf: str) -> DataFrame:
    return store.new(document_table(spark, sf), _candidates(spark, sf)).select("doc_id", "filename", "path")


@query(f"""WITH c AS (SELECT filename, path, chunk_index, chunk_text, doc_id FROM {CHUNKS_SQL}),
  a AS (SELECT *, 0 AS new FROM c WHERE doc_id % 3 <> 0 UNION ALL SELECT * REPLACE ('new ' || chunk_text AS chunk_text), 1 FROM c WHERE doc_id % 2 = 0)
  SELECT filename, path, chunk_index, chunk_text FROM a QUALIFY row_number() OVER (PARTITION BY filename, path, chunk_index ORDER BY new DESC, chunk_text DESC) = 1""")
def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk_table(spark, sf).select("filename", "path", "chunk_index", "chunk_text", "doc_id")
    old, fresh = rows.filter("doc_id % 3 <> 0").drop("doc_id"), rows.filter("doc_id % 2 = 0").drop("doc_id").withColumn("chunk_text", F.concat(F.lit("new "), "chunk_text"))
    return store.put_chunks(old, fresh)


@query(f"SELECT filename, path, doc_number FROM (SELECT filename, path, min(doc_number) AS doc_number FROM {CHUNKS_SQL} WHERE doc_id % 2 = 0 GROUP BY ALL)")
def store_replace(spark: SparkSession, sf: str) -> DataFrame:
    """A store written, then replaced: what is read back."""
    at = store.Store(spark, scratch(spark, "store"))
    rows = chunk_table(spark, sf)
    at.save(document_table(spark, sf), rows.select("filename", "path", "chunk_index", "chunk_text"))
    half = rows.filter("doc_id % 2 = 0")
    at.save(half.groupBy("filename", "path").agg(F.min("doc_number").alias("doc_number")), half.select("filename", "path", "chunk_index", "chunk_text"), replace=True)
    return at.documents().select("filename", "path", "doc_number")


@query(f"SELECT 'documents' AS what, count(*) AS n FROM {DOCUMENTS_SQL} UNION ALL SELECT 'chunks', count(*) FROM {CHUNKS_SQL}")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return store.stats(document_table(spark, sf), chunk_table(spark, sf))


@query(f"SELECT count(*) AS total_chunks FROM {CHUNKED_SQL}")
def total_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The sum of the documents' chunk counts."""
    return process_document(spark, sf).agg(F.sum("chunk_count").alias("total_chunks"))


@query(f"SELECT lang, count(*) AS total, count(*) FILTER ({words_sql('text')} > 0) AS ok, count(*) FILTER ({words_sql('text')} = 0) AS failed, count(*) FILTER ({words_sql('text')} > 400) AS split FROM documents GROUP BY lang")
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = T.word_count(F.col("text"))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("total"), F.count_if(n > 0).alias("ok"), F.count_if(n == 0).alias("failed"), F.count_if(n > S.max_words).alias("split"))


@query("SELECT source AS filename, '/corpus/' || doc_id AS path, len(string_split(text, chr(10)))::INT AS chunk_count, array_to_string(string_split(text, chr(10)), '|') AS joined, lang AS doc_number, NULL::VARCHAR AS clean_text FROM documents")
def intermediate_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with chunks written as JSON and read again: without their raw and clean text."""
    from ..sources.files import read_json, write_json

    rows = table(spark, sf, "documents").select(F.col("source").alias("filename"), F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("raw_text"), F.col("text").alias("clean_text"), F.split("text", "\n").alias("chunks"), F.col("lang").alias("doc_number"))
    path = scratch(spark, "json")
    write_json(rows.withColumn("chunk_count", F.size("chunks")), path)
    return read_json(spark, path).select("filename", "path", "chunk_count", F.array_join("chunks", "|").alias("joined"), "doc_number", "clean_text")


# --- vectors and ranking --------------------------------------------------------------------------

K = 50
TOP_SQL = f"""(SELECT q.vec_id AS question_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY rank <= {K})"""
HITS_SQL = f"(SELECT t.question_id, t.rank, t.similarity, c.* FROM {TOP_SQL} t JOIN {CHUNKS_SQL} c ON t.vec_id = c.doc_id)"


def top(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return vectors.search(rows, rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "question_id"), K)


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return top(spark, sf).join(chunk_table(spark, sf), F.col("vec_id") == F.col("doc_id")).drop("vec_id")


@query(f"SELECT question_id, vec_id, round(similarity, 6) AS similarity, rank FROM {TOP_SQL}")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return top(spark, sf).select("question_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _ranked_sql() -> str:
    tax = lambda d, k, m: f"CASE WHEN length(split_part({d}, '.', 1)) >= {k} THEN try_cast(substr(split_part({d}, '.', 1), 1, {k}) AS INT) * {m} END"
    same = lambda k, m: f"({tax('tn', k, m)} <> 0 AND {tax('doc_number', k, m)} = {tax('tn', k, m)})"
    rel = f"CASE WHEN is_first THEN NULL WHEN filename = tf THEN 'same_document' WHEN doc_number = tn THEN 'same_doc_number' WHEN {same(3, 10)} THEN 'same_specific_range' WHEN {same(2, 100)} THEN 'same_subgroup' WHEN {same(1, 1000)} THEN 'same_major_group' ELSE 'unrelated' END"
    boost = "CASE relationship WHEN 'same_document' THEN 1.5 WHEN 'same_doc_number' THEN 1.4 WHEN 'same_specific_range' THEN 1.35 WHEN 'same_subgroup' THEN 1.3 WHEN 'same_major_group' THEN 1.2 WHEN 'unrelated' THEN 1.0::DOUBLE / 1.2::DOUBLE ELSE 1.0 END::DOUBLE"
    near = "CASE WHEN is_first OR filename <> tf THEN 1.0 WHEN abs(chunk_index - ti) = 1 THEN 1.3 WHEN abs(chunk_index - ti) = 2 THEN 1.15 WHEN abs(chunk_index - ti) <= 5 THEN 1.05 ELSE 1.0 END::DOUBLE"
    return f"""(WITH h AS (SELECT *, rank = min(rank) OVER w AS is_first, first_value(filename) OVER w AS tf, first_value(doc_number) OVER w AS tn, first_value(chunk_index) OVER w AS ti FROM {HITS_SQL} WINDOW w AS (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  r AS (SELECT *, {rel} AS relationship FROM h), b AS (SELECT *, {boost} AS document_boost, {near} AS adjacency_boost FROM r)
  SELECT question_id, doc_id, chunk_id, filename, doc_number, chunk_index, chunk_text, relationship, document_boost, adjacency_boost, similarity AS original_similarity, similarity * document_boost * adjacency_boost AS similarity,
    row_number() OVER (PARTITION BY question_id ORDER BY similarity * document_boost * adjacency_boost DESC, rank) AS rank FROM b)"""


RANKED_SQL = _ranked_sql()


@query(f"SELECT question_id, doc_id, filename, doc_number, relationship, round(document_boost, 6) AS document_boost, adjacency_boost, round(original_similarity, 6) AS original_similarity, round(similarity, 6) AS similarity, rank FROM {RANKED_SQL}")
def doc_aware_rank(spark: SparkSession, sf: str) -> DataFrame:
    found = ranking.by_document(hits(spark, sf))
    return found.select("question_id", "doc_id", "filename", "doc_number", "relationship", F.round("document_boost", 6).alias("document_boost"), "adjacency_boost", F.round("original_similarity", 6).alias("original_similarity"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, (CASE doc_id % 9 WHEN 1 THEN 1.3 WHEN 2 THEN 1.15 WHEN 6 THEN 1.0 WHEN 7 THEN 1.0 WHEN 8 THEN 1.0 ELSE 1.05 END)::DOUBLE AS boost FROM documents")
def adjacency_boost(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ranking.adjacency(F.col("doc_id") % 9).alias("boost"))


#: A question is a whole sentence: the first one of a document.
SENTENCE = "regexp_extract(text, '^[^.!?]*[.!?]?'"
QUESTIONS_SQL = f"(SELECT doc_id AS question_id, {SENTENCE}) AS question FROM documents WHERE doc_id % 100 = 0)"


def asked_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked hits with the question: the first sentence of the document with the question's id."""
    questions = table(spark, sf, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("question_id"), F.expr(f"{SENTENCE}, 0)").alias("question"))
    return ranking.by_document(hits(spark, sf)).join(questions, "question_id")


def _rerank_sql() -> str:
    cut = "substr(chunk_text, 1, greatest(2028 - length(question), 0))"
    period, space = (f"(CASE WHEN strpos(reverse({cut}), '{m}') > 0 THEN length({cut}) - strpos(reverse({cut}), '{m}') ELSE -1 END)" for m in (".", " "))
    room = "(2028 - length(question))"
    passage = f"CASE WHEN length(question) + length(chunk_text) <= 2048 THEN chunk_text WHEN {room} < 100 THEN substr(chunk_text, 1, 100) WHEN {period} > {room} * 0.8::DOUBLE THEN substr({cut}, 1, {period} + 1) WHEN {space} > {room} * 0.9::DOUBLE THEN substr({cut}, 1, {space}) ELSE {cut} END"
    ws = lambda x: rf"list_distinct(regexp_extract_all(lower({x}), '[^\s]+'))"
    return f"""(WITH p AS (SELECT *, {passage} AS passage FROM {RANKED_SQL} JOIN {QUESTIONS_SQL} USING (question_id)),
  s AS (SELECT *, CASE WHEN rank <= 20 THEN CASE WHEN len({ws('question')}) = 0 THEN 0.0 ELSE len(list_intersect({ws('question')}, {ws('passage')}))::DOUBLE / len({ws('question')}) END END AS cross_score FROM p),
  o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY (rank > 20)::INT, cross_score DESC, rank) AS place FROM s)
  SELECT question_id, question, doc_id, doc_number, chunk_text, similarity, cross_score, row_number() OVER (PARTITION BY question_id ORDER BY place) AS rank FROM o WHERE rank > 20 OR place <= 10)"""


RERANKED_SQL = _rerank_sql()


@query(f"SELECT question_id, doc_id, round(cross_score, 6) AS cross_score, rank FROM {RERANKED_SQL}")
def cross_rerank(spark: SparkSession, sf: str) -> DataFrame:
    found = ranking.rerank(asked_hits(spark, sf))
    return found.select("question_id", "doc_id", F.round("cross_score", 6).alias("cross_score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT question_id, round(min(cross_score), 6) AS min_score, round(max(cross_score), 6) AS max_score, round(avg(cross_score), 6) AS mean_score FROM {RERANKED_SQL} GROUP BY ALL")
def score_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = ranking.score_stats(ranking.rerank(asked_hits(spark, sf)))
    return found.select("question_id", *[F.round(c, 6).alias(c) for c in ("min_score", "max_score", "mean_score")])


@query(f"SELECT question_id, doc_id, rank, round(similarity, 6) AS similarity FROM {RANKED_SQL} WHERE rank <= {S.search_k}")
def retrieve(spark: SparkSession, sf: str) -> DataFrame:
    found = ranking.by_document(hits(spark, sf)).filter(F.col("rank") <= S.search_k)
    return found.select("question_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


WINDOW_SIZE, MAX_TOKENS = 4096, 400


def _fit_sql() -> str:
    empty = prompt_sql("simple", "''", "question")
    n_words = rf"(len(regexp_extract_all({empty}, '[^\s]+')) + sum(len(regexp_extract_all(chunk_text, '[^\s]+'))) OVER w)"
    n_chars = f"(length({empty}) + sum(length(chunk_text)) OVER w + 2 * (row_number() OVER w - 1))"
    return f"""(SELECT * FROM (SELECT question_id, question, doc_id, doc_number, chunk_text, rank, greatest(floor({n_words} * 1.3::DOUBLE), floor({n_chars} / 4.0))::BIGINT AS prompt_tokens
  FROM {RANKED_SQL} JOIN {QUESTIONS_SQL} USING (question_id) WINDOW w AS (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING)) WHERE prompt_tokens <= {WINDOW_SIZE - MAX_TOKENS - S.prompt_reserve})"""


FIT_SQL = _fit_sql()


def fitted(spark: SparkSession, sf: str) -> DataFrame:
    return context.fit(asked_hits(spark, sf), WINDOW_SIZE, MAX_TOKENS)


@query(f"SELECT question_id, doc_id, rank, prompt_tokens, round(prompt_tokens * 100.0::DOUBLE / {WINDOW_SIZE - MAX_TOKENS - S.prompt_reserve}, 1) AS utilisation FROM {FIT_SQL}")
def context_fit(spark: SparkSession, sf: str) -> DataFrame:
    return fitted(spark, sf).select("question_id", "doc_id", F.col("rank").cast("long").alias("rank"), "prompt_tokens", "utilisation")


@query(f"SELECT question_id, array_to_string(list_sort(list_distinct(list(doc_number))), ', ') AS citations FROM {FIT_SQL} GROUP BY ALL")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    return context.citations(fitted(spark, sf)).select("question_id", F.array_join("citations", ", ").alias("citations"))


@query(f"""SELECT question_id, question, 'Based on DOD policies, here''s what I found regarding ''' || question || ''':' || chr(10) || chr(10) || 'Relevant policy excerpt:' || chr(10) || substr(first_text, 1, 200) || '...' || chr(10) || chr(10) || 'Note: LLM not available, showing simplified response.' || chr(10) || chr(10) || 'Found ' || n || ' relevant policy sections.' AS answer
  FROM (SELECT question_id, question, arg_min(chunk_text, "rank") AS first_text, count(*) AS n FROM {RANKED_SQL} JOIN {QUESTIONS_SQL} USING (question_id) GROUP BY question_id, question)""")
def answer(spark: SparkSession, sf: str) -> DataFrame:
    return context.answers(asked_hits(spark, sf))


@query(f"""SELECT question_id, rank, '[Chunk ' || rank || '] Source: ' || filename || chr(10) || 'Document Number: ' || doc_number || chr(10) || 'Similarity: ' || format('{{:.3f}}', similarity) || chr(10) || repeat('-', 40) || chr(10) || CASE WHEN length(chunk_text) > 500 THEN substr(chunk_text, 1, 500) || '...' ELSE chunk_text END AS shown
  FROM (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank, filename, doc_number, similarity, chunk_text FROM {RANKED_SQL})""")
def context_display(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as they are shown with an answer, numbered from 1."""
    return context.display(ranking.by_document(hits(spark, sf))).select("question_id", F.col("rank").cast("long").alias("rank"), "shown")


@query("SELECT doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'log of ' || lang END) AS details, CASE WHEN doc_id % 3 = 0 THEN 'answer ' || source ELSE 'answer ' || source || chr(10) || 'Response:' || chr(10) || 'x' END AS answer FROM documents")
def response_split(spark: SparkSession, sf: str) -> DataFrame:
    """A printed response's answer, and the details before the first marker."""
    text = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'answer ' || source ELSE ' log of ' || lang || '\\nResponse:\\nanswer ' || source || '\\nResponse:\\nx ' END")
    return table(spark, sf, "documents").select("doc_id", context.response_parts(text).alias("r")).select("doc_id", "r.details", "r.answer")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'all-MiniLM-L6-v2' WHEN 1 THEN 'all-mpnet-base-v2' WHEN 2 THEN 'BAAI/bge-base-en-v1.5' WHEN 3 THEN 'mixedbread-ai/mxbai-embed-large-v1' ELSE 'org/' || lang END AS model,
  CASE doc_id % 4 WHEN 0 THEN 'policies/dodd' WHEN 1 THEN 'policies/dodi' WHEN 2 THEN 'policies/test' ELSE source END AS folder FROM documents""")
def names_back(spark: SparkSession, sf: str) -> DataFrame:
    """The model of a collection's name, and where a chosen folder is."""
    name = F.expr("'chunks_' || CASE doc_id % 5 WHEN 0 THEN 'all_MiniLM_L6_v2' WHEN 1 THEN 'all_mpnet_base_v2' WHEN 2 THEN 'BAAI_bge_base_en_v1.5' WHEN 3 THEN 'mixedbread_ai_mxbai_embed_large_v1' ELSE 'org_' || lang END")
    folder = F.expr("CASE doc_id % 4 WHEN 0 THEN 'dodd' WHEN 1 THEN 'dodi' WHEN 2 THEN 'test' ELSE source END")
    return table(spark, sf, "documents").select("doc_id", T.model_of_collection(name).alias("model"), T.folder_path(folder).alias("folder"))


@query(f"SELECT v.vec_id, coalesce(c.chunk_text, '[Text unavailable for chunk ' || v.vec_id || ']') AS chunk_text FROM embeddings v LEFT JOIN (SELECT doc_id, chunk_text FROM {CHUNKS_SQL} WHERE doc_id % 4 <> 0) c ON v.vec_id = c.doc_id")
def missing_text_placeholder(spark: SparkSession, sf: str) -> DataFrame:
    texts = chunk_table(spark, sf).filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("vec_id"), "chunk_text")
    return context.with_text(table(spark, sf, "embeddings").select("vec_id"), texts, "vec_id")


VECTORS_SQL = "(SELECT vec_id, 'file' || (vec_id % 20) || '.pdf' AS filename, '/corpus/' || (vec_id % 20) AS path, 'model_' || label AS collection FROM embeddings)"


def vector_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.expr("'file' || (vec_id % 20) || '.pdf'").alias("filename"), F.expr("'/corpus/' || (vec_id % 20)").alias("path"), F.expr("'model_' || label").alias("collection"))


@query(f"SELECT count(DISTINCT filename) AS n_files, count(*) AS n_vectors, 123.46::DOUBLE AS size_mb, round(count(*) * 10 / 1024.0::DOUBLE, 2) AS expected_mb, round(123.46::DOUBLE / round(count(*) * 10 / 1024.0::DOUBLE, 2), 1) AS bloat FROM {VECTORS_SQL}")
def vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A collection that takes 123.456 MB."""
    return vectors.stats(vector_table(spark, sf), 123.456)


@query(f"SELECT filename, min(path) AS path, count(*) AS chunk_count, 'N/A' AS created_at FROM {VECTORS_SQL} GROUP BY filename ORDER BY filename")
def list_documents_vec(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.list_documents(vector_table(spark, sf))


@query(f"SELECT n.collection, count(v.vec_id) AS n FROM (SELECT DISTINCT 'model_' || (vec_id % 15) AS collection FROM embeddings) n JOIN {VECTORS_SQL} v USING (collection) GROUP BY ALL")
def collections_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_table(spark, sf)
    names = rows.select(F.expr("'model_' || (vec_id % 15)").alias("collection")).distinct()
    return names.join(rows.groupBy("collection").agg(F.count("*").alias("n")), "collection")


@query("SELECT vec_id, floor((row_number() OVER (ORDER BY vec_id) - 1) / 1000)::INT AS batch FROM embeddings")
def vector_write_batches(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.batches(table(spark, sf, "embeddings").select("vec_id"), "vec_id", S.vector_batch, per_part=100).select("vec_id", "batch")


@query(f"SELECT chunk_id, filename, chunk_index FROM {CHUNKS_SQL}")
def embedding_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks embedded: their ids and places; the vectors are hash_embed's."""
    return vectors.embed(chunk_table(spark, sf), "chunk_text").filter("embedding is not null").select("chunk_id", "filename", "chunk_index")


@query(f"SELECT chunk_id, filename, chunk_index FROM {CHUNKS_SQL}")
def embedding_flow_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The flow over a store that has every chunk."""
    rows = chunk_table(spark, sf)
    return vectors.flow(rows, rows.limit(0)).filter("embedding is not null").select("chunk_id", "filename", "chunk_index")


@query(f"SELECT chunk_id, filename, chunk_index FROM {CHUNKS_SQL}")
def embedding_flow_new(spark: SparkSession, sf: str) -> DataFrame:
    """The flow over an empty store: every chunk is new."""
    rows = chunk_table(spark, sf)
    return vectors.flow(rows.limit(0), rows).filter("embedding is not null").select("chunk_id", "filename", "chunk_index")


@query()
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.embed(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "embedding")


context.GENERATORS["first-sentence"] = lambda: lambda prompts: prompts.str.split(".").str[0]


@query(f"SELECT doc_id, split_part({prompt_sql('simple', 'text', 'lang')}, '.', 1) AS response FROM documents")
def generate_answer(spark: SparkSession, sf: str) -> DataFrame:
    """The generator hook, with a generator that returns the prompt's first sentence."""
    prompts = table(spark, sf, "documents").select("doc_id", context.prompt(F.col("text"), F.col("lang"), F.lit("simple")).alias("prompt"))
    return context.generate(prompts, "first-sentence").select("doc_id", "response")


@query(rf"""SELECT '/corpus/' || doc_id AS path, f AS filename, coalesce(
  CASE WHEN regexp_matches(f, '(?i)(\d{{4}})(\d{{2}})p?\.pdf$') THEN regexp_extract(f, '(?i)(\d{{4}})(\d{{2}})p?\.pdf$', 1) || '.' || regexp_extract(f, '(?i)(\d{{4}})(\d{{2}})p?\.pdf$', 2) END,
  nullif(regexp_extract(f, '(?i)DOD[IDM][\s_-]?(\d+\.\d+)', 1), ''), nullif(regexp_extract(p, '(?i)NUMBER\s+(\d+\.\d+)', 1), ''), nullif(regexp_extract(p, '(?i)DOD[IDM][\s_-]?(\d+\.\d+)', 1), '')) AS doc_number, chunk_count
  FROM (SELECT doc_id, {NAMES[0].replace('string', 'varchar')} AS f FROM documents) JOIN (SELECT doc_id, substr(value, 1, 2000) AS p FROM ({clean_sql(LISTED_SQL)})) USING (doc_id) JOIN (SELECT doc_id, count(*)::INT AS chunk_count FROM {CHUNKED_SQL} GROUP BY doc_id) USING (doc_id)""")
def process_document(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.files import process

    raw = listed(spark, sf).select(F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string")).alias("path"), F.expr(NAMES[0]).alias("filename"), F.col("text").alias("raw_text"))
    return process(raw).select("path", "filename", "doc_number", "chunk_count")


@query()
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    """The Parquet files of the test tables, as the directory scan sees them."""
    from ..sources.files import scan

    return scan(spark, sf, pattern="*.parquet").select("filename", "length")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming aggregation of streaming.ingest.windowed, run over the whole table at once."""
    from ..streaming.ingest import windowed

    return windowed(table(spark, sf, "events")).withColumn("total", F.round("total", 4))
