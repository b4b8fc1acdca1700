import hashlib
import re

import numpy as np
import pytest

from folioflux.llm import exact

NORMAL = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_against_brute_force(odd, none):
    rows = [(r["doc_id"], NORMAL(r["text"])) for r in odd.collect()]
    got = exact.duplicates(odd).collect()
    assert len(got) == len(rows)
    keep = {t: min((i for i, x in rows if x == t and i is not None), default=None) for _, t in rows}
    want = sorted((str(i), str(keep[t]), sum(x == t for _, x in rows), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["sha"]) for r in got) == want
    kept = [r["sha"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len(keep)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact.duplicates(none).count() == 0


def test_one_of_each(odd, none):
    kept = exact.one_of_each(odd)
    assert kept.columns == odd.columns
    texts = [NORMAL(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({NORMAL(r["text"]) for r in odd.collect()})
    assert exact.one_of_each(none).count() == 0


@pytest.mark.parametrize("capacity", [1, 3, 50])
def test_directory(capacity):
    counts = {k: (k * 7919) % 5 for k in range(0, 256, 3)} | {200: 40}
    found = exact.Directory()
    short = found.split(counts, 8, capacity)
    entries = found.entries()
    assert len(entries) == 1 << found.depth
    held = {}
    for prefix, n in counts.items():
        b = entries[prefix >> (8 - found.depth)]
        bits, used = found.buckets[b]
        assert prefix >> (8 - used) == bits
        held[b] = held.get(b, 0) + n
    assert all(n <= capacity or b in short for b, n in held.items())
    assert set(entries) == set(range(len(found.buckets)))
    starts, owners = found.runs()
    assert [owners[(starts <= np.uint64(x << 56)).sum() - 1] for x in range(256)] == [entries[x >> (8 - found.depth)] for x in range(256)]


def test_a_directory_goes_as_deep_as_the_hashes_need(spark):
    close = [(1 << 40) + k for k in range(50)] + [-(k + 1) for k in range(50)] + [k << 57 for k in range(-64, 64)]
    sigs = spark.createDataFrame([(x,) for x in close], "hash long")
    found = exact.directory_of(sigs, capacity=1, step_bits=8)
    starts, owners = found.runs()
    held = [int(owners[np.searchsorted(starts, np.uint64(x % (1 << 64)), "right") - 1]) for x in set(close)]
    assert len(set(held)) == len(held) and found.depth > 60


def test_one_row_of_a_text_and_id_stays_however_often_it_repeats(spark, monkeypatch):
    from folioflux.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    docs = spark.createDataFrame([(None, "")] * 40 + [(None, None)] * 40 + [(7, "x")] * 30 + [(3, "x"), (9, "y")], "doc_id long, text string").repartition(4)
    got = exact.duplicates(docs).collect()
    assert len(got) == 112 and sorted((r["group_size"], str(r["keep_id"])) for r in got if r["kept"]) == [(1, "9"), (31, "3"), (80, "None")]
    assert sorted(str(r["doc_id"]) for r in exact.one_of_each(docs).collect()) == ["3", "9", "None"]


def test_chains_compare_bytes():
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), exact.ENTRY.values())], names=list(exact.ENTRY))

    rows = [(0, 5, "s1", "one", 9, 1), (0, 5, "s2", "two", 4, 2), (0, 5, "s1", "one", 3, 1), (0, 6, "s3", "three", None, 1)]
    out = [tuple(r.values()) for b in exact._owned(iter([batch(rows[:2]), batch(rows[2:])])) for r in b.to_pylist()]
    assert out == [(0, 5, "s1", 0, 3, 2), (0, 5, "s2", 1, 4, 2), (0, 6, "s3", 0, None, 1)]
    with pytest.raises(ValueError, match="SHA"):
        list(exact._owned(iter([batch([(0, 5, "s1", "one", 9, 1), (0, 5, "s1", "two", 4, 2)])])))
