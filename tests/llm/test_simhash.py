import random

import numpy as np
import pytest
import xxhash

from folioflux.llm import simhash
from folioflux.llm.common import fresh_dir
from folioflux.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def groups(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 300):
        text = " ".join(rng.choice(["Ab", "ÉÀ", "x", "the", "\x1c", "\u00a0y"]) for _ in range(n)) + rng.choice(["", "\n", " \t"])
        assert simhash.fingerprint(text) == plain(text)
        assert simhash.fingerprint(text, block=7) == plain(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize(("full", "radius"), [(32, 2), (3, 2), (3, 1)])
def test_components_against_brute_force(spark, full, radius):
    rng, fps = random.Random(full + radius), set()
    for k in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(40 if k == 0 else 3):
            x = base
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64 if k else 16)
            fps.add(x)
    signed = [int(x) for x in np.array(sorted(fps), np.uint64).view(np.int64)]
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    want = {n: r for n, r in groups(signed, near).items() if any(n in p for p in near)}
    path = fresh_dir(spark, "test")
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = components(simhash.links(df, path, len(signed), radius, full), path)
    assert {r["node"]: r["root"] for r in got.collect()} == want


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_any_grid_keeps_near_pairs_together(n):
    g = simhash.groups_for(n, 2)
    assert 4 <= g <= 16


def test_rows(odd, none):
    rows = [(r["doc_id"], plain(r["text"])) for r in odd.collect()]
    near = [(a, b) for _, a in rows for _, b in rows if (a ^ b).bit_count() <= 2]
    root = groups({f for _, f in rows}, near)
    least = {r: min((i for i, f in rows if root[f] == r and i is not None), default=None) for r in root.values()}
    got = simhash.near_duplicates(odd).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in got) == sorted((str(i), f, str(least[root[f]])) for i, f in rows)
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each(odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and {1, 3, 5, 7} <= set(ids) and not {2, 4, 6} & set(ids)
    assert not any(r["doc_id"] is None for r in rows)  # both are near copies of a row with an id
    assert simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 300)], [(k, (k * 7 + 3) % 100) for k in range(100)]])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"), fresh_dir(spark, "test"))
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert {r["node"]: r["root"] for r in got.collect()} == groups(nodes, edges and [(a, b) for a, b in edges if a != b])


def test_every_component_keeps_a_row_where_ids_repeat(spark):
    rows = [(1, "one text about the sea and its many ships"), (1, "quite another thing: numbers, sums, proofs"), (2, "one text about the sea and its many ships"), (3, "quite another thing: numbers, sums, proofs")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == rows[:2]


def brute_one_of_each(rows):
    """rows: (doc_id, text); the one that stays of each component."""
    import hashlib

    fps = {plain(t) for _, t in rows}
    root = groups(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    held = {}
    for i, t in rows:
        held.setdefault(root[plain(t)], []).append((i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), i, t))
    return sorted((str(min(x)[3]), str(min(x)[4])) for x in held.values())


def test_one_row_of_each_component_against_brute_force(spark):
    rng, words = random.Random(11), [f"w{k}" for k in range(60)]
    bases = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(12)]
    rows = [(5, "one different text"), (5, "another text altogether, about numbers"), (3, "one different text"), (None, "only here, and without any id"), (None, "only here, and without any id"), (5, None), (None, "")]
    for _ in range(150):  # near copies; ids repeat, also over components, and some are missing
        text = rng.choice(bases).split(" ")
        text[rng.randrange(len(text))] = "changed"
        rows.append((rng.choice([None, *range(25)]), " ".join(text)))
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == brute_one_of_each(rows)


def test_rows_that_differ_in_any_type_are_chosen_alike(spark):
    rows = [(1, "same text here", float(k), [k, 1], {"k": k}) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, parts array<int>, more map<string,int>")
    assert {str(simhash.one_of_each(df.repartition(k)).collect()) for k in (1, 3, 5)} == {str(df.filter("score = 0").collect())}
