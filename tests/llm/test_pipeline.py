import hashlib
import re

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from folioflux.llm import langid, mixing, queries
from folioflux.llm.common import held_out

from .test_bpe import RANKS, reference  # noqa: F401
from .test_simhash import groups, plain as fingerprint

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark, reference):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.filter(held_out(F.col("doc_id"), 5) != 0))
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    rows = [r for r, (lang, score, _) in zip(rows, model.predict([r[1] for r in rows])) if lang != "und" and score >= pipeline.LEAST_SCORE]
    first = {}
    for r in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    rows = sorted(first.values())
    fps = {r[0]: fingerprint(r[1]) for r in rows}
    nodes = set(fps.values())
    root = groups(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in sorted(fps.items()):
        least.setdefault(root[f], i)
    rows = [r for r in rows if least[root[fps[r[0]]]] == r[0]]
    kept = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["_copies"] for r in mixing.mix(kept, queries.WEIGHTS, seed=queries.SEED).collect()}
    want = []
    for i, text, _ in rows:
        ids = reference.encode_ordinary(text)
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        want += [row] * copies.get(i, 0)
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(want)
    assert pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns_and_take_odd_rows(spark, plain, k):
    _, stage = pipeline.STAGES[k]
    got = stage(spark, plain, SF)
    assert got.columns == plain.columns and got.dtypes == plain.dtypes
    assert got.count() > 0
    assert stage(spark, plain.filter("false"), SF).count() == 0


def test_last_stage(spark, plain):
    assert pipeline.STAGES[-1][1](spark, plain, SF).count() == plain.count()
