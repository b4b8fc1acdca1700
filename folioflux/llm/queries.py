"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, html, images, langid, mixing, sharding, simhash, toxicity, urls
from .common import fresh_dir, held_out, table

#: Arrivals that op1 appends.
WAVES = 4
#: Target weights of op2: of the text, not of the documents; every other source has weight 1.
WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 0.5}
SEED = 17
#: The rules of op5: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
TOXIC_AT = 0.7
RANKS = "byte_bpe_50k.tiktoken"


def ranks(name: str = RANKS) -> tuple[bytes, str]:
    """The content of a public rank file, and its pattern; the driver alone reads the file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents appended in waves and compacted: the shard of every document."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.Sharded(spark, fresh_dir(spark, "shards"))
    for wave in sharding.waves(docs, "doc_id", WAVES):
        store.append(wave)
    store.compact()
    store.vacuum()  # nothing is old enough to go
    return store.assignments("doc_id").select("doc_id", F.element_at(F.split("path", "/"), -1).alias("shard"), "tier", F.col("n_rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "version")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, seed=SEED)
    return mixed.select(
        "doc_id", "text", "lang", "source", "n_chars", F.col("_copy").cast("long").alias("copy"), F.col("_copies").cast("long").alias("n_copies"),
        F.round("_rate", 6).alias("rate"), F.col("_key_shuffle").alias("shuffle_key"),
    )


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(held_out(F.col("doc_id"), 5) != 0))
    return langid.predict(docs, model).select("doc_id", (held_out(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "family")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, RULES))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(held_out(F.col("doc_id"), 3) != 1))
    return toxicity.score(docs, model).select("doc_id", (held_out(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op8_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding drawn as a picture, some as crops and edits of others; their components."""
    found = images.copies(images.render(table(spark, sf_dir, "embeddings")))
    return found.select(F.col("img").alias("vec_id"), "component_id", F.col("n_links").cast("long").alias("n_links"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *ranks())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _op2_sql() -> str:
    weight = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1.0 END"
    return f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS units, ({weight})::DOUBLE AS weight FROM documents GROUP BY source),
total AS (SELECT sum(units)::DOUBLE / sum(weight)::DOUBLE AS a_unit FROM sizes WHERE units > 0),
rates AS (SELECT source, CASE WHEN units > 0 THEN a_unit * weight / units ELSE 0.0 END AS rate FROM sizes, total),
steps AS (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 40))::BIGINT + 1)) AS k FROM rates),
p AS (SELECT source, rate, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k)) WHEN k = 0 THEN 1.0 ELSE 0.0 END AS p FROM steps),
cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
dist AS (SELECT source, rate, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source, rate),
drawn AS (
  SELECT d.*, rate, len(list_filter(cdf, lambda c: c <= u)) AS n_copies
  FROM (SELECT *, ('0x' || md5('{SEED}:draw:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents) d
  JOIN dist ON d.source IS NOT DISTINCT FROM dist.source)
SELECT doc_id, text, lang, source, n_chars, copy, n_copies::BIGINT AS n_copies, round(rate, 6) AS rate,
  ('0x' || md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy)[1:13])::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM drawn)"""


def _op5_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH rules(h, p, verdict) AS (VALUES {rules}),
parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages)
SELECT page_id, host, path,
  (SELECT max_by(h || r.p, length(h || r.p)) FROM rules r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)) AS rule,
  coalesce((SELECT max_by(verdict, length(h || r.p)) FROM rules r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)), 'allow') AS verdict
FROM parts"""


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AND row_number() OVER (PARTITION BY norm, doc_id) = 1 AS kept,
  sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": _op2_sql(), "op5_urls": _op5_sql(), "op6_exact": OP6_SQL}
