import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.llm import images


def vectors(spark, n=60, close=0, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.125, (n, 64))
    v[n - close :] = v[0] + rng.normal(0, 0.012, (close, 64))
    return spark.createDataFrame([(10 * k + 5, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")


def test_crops_and_edits_are_found(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 0.125, 64).tolist()) for k in range(60)]
    media = images.render(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r["img"]: r["component_id"] for r in images.copies(media).collect()}
    for k in range(60):
        assert got[k] == (k - k % 10 if k % 10 in (1, 2) else k)


def test_a_crowd_of_near_copies_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(images, "FULL", 4)
    got = images.copies(images.render(vectors(spark, 80, close=40))).collect()
    assert len(got) == 80
    size = Counter(r["component_id"] for r in got)
    assert size.most_common(1)[0][1] >= 40 and sorted(size.values())[:-1] == [1] * (len(size) - 1)


def test_edges(spark):
    noise = images.encode(np.random.default_rng(0).normal(128, 40, (64, 64)))
    rows = [(1, noise, 0), (1, noise, 0), (2, noise, 0), (None, noise, 0), (3, None, 0), (4, b"", 0), (5, b"junk", 0), (6, b"P5\n4 4\n255\n" + bytes(16), 0), (7, images.encode(np.full((64, 64), 9.0)), 0), (8, b"P5\n99 99\n255\nshort", 0)]
    media = spark.createDataFrame(rows, "img long, image binary, corner int")
    got = sorted((str(r["img"]), str(r["component_id"]), r["n_links"]) for r in images.copies(media).collect())
    assert got == [("1", "1", 1), ("1", "1", 1), ("2", "1", 1), ("3", "3", 1), ("4", "3", 1), ("5", "5", 0), ("6", "6", 0), ("7", "7", 0), ("8", "8", 0), ("None", "None", 0)]
    assert images.copies(media.limit(0)).count() == 0
    flat = images.render(spark.createDataFrame([(1, None), (None, [1.0]), (2, [1.0, None])], "vec_id long, embedding array<float>"))
    assert flat.count() == 2


def _moved(a, angle, factor):
    """Pictures turned about their middle and resized, bilinear."""
    high, wide = a.shape[1:]
    y, x = np.mgrid[: int(high * factor), : int(wide * factor)].astype(float)
    y, x = (y + 0.5) / factor - high / 2, (x + 0.5) / factor - wide / 2
    sy, sx = (np.sin(angle) * x + np.cos(angle) * y + high / 2 - 0.5).clip(0, high - 1.001), (np.cos(angle) * x - np.sin(angle) * y + wide / 2 - 0.5).clip(0, wide - 1.001)
    i, j = sy.astype(int), sx.astype(int)
    v, u = sy - i, sx - j
    return a[:, i, j] * (1 - u) * (1 - v) + a[:, i, j + 1] * u * (1 - v) + a[:, i + 1, j] * (1 - u) * v + a[:, i + 1, j + 1] * u * v


def drawn(n, seed=0):
    rng = np.random.default_rng(seed)
    patterns = images._patterns(64)
    return np.stack([128 + 40 * np.tensordot(rng.normal(0, 0.125, 64).astype(np.float32), patterns, 1) for _ in range(n)])


def brute_links(media):
    """All pairs of images whose corners agree."""
    seen = {r["img"]: images.describe(images.decode(r["image"])[None])[1] for r in media.collect()}
    return {(a, b) for a in seen for b in seen if a < b and images.agree(seen[a], seen[b])}


def brute_agree(a, b):
    """The votes one by one, in dictionaries."""
    cell = 0.0
    matches = [(i, j) for i in range(len(a)) for j in range(len(b)) if sum(int(x ^ y).bit_count() for x, y in zip(a["bits"][i], b["bits"][j])) <= images.MAX_HAMMING]
    if not matches:
        return False
    extent = max(max(a[i]["x"], a[i]["y"], b[j]["x"], b[j]["y"]) for i, j in matches)
    cell = images.CELL * max(1.0, float(extent) / 64)
    for k in range(16):
        half, votes = [0.5 * (k >> n & 1) for n in range(4)], {}
        for i, j in matches:
            p, q = a[i], b[j]
            size, turn = q["scale"] / p["scale"], float(q["angle"] - p["angle"])
            sx = (q["x"] - size * (math.cos(turn) * p["x"] - math.sin(turn) * p["y"])) / cell
            sy = (q["y"] - size * (math.sin(turn) * p["x"] + math.cos(turn) * p["y"])) / cell
            motion = (math.floor(math.log(size) / (2 * math.log(images.STEP)) + half[0] + 0.25), math.floor(turn * 6 / math.pi + half[1]) % 12, math.floor(sx + half[2]), math.floor(sy + half[3]))
            votes.setdefault(motion, set()).add((p["x"] // images.SPOT, p["y"] // images.SPOT))
        spots = [len({(c["x"] // images.SPOT, c["y"] // images.SPOT) for c in side}) for side in ([a[i] for i, _ in matches], [b[j] for _, j in matches])]
        if max(map(len, votes.values())) >= max(images.MIN_VOTES, images.SHARE * min(spots)):
            return True
    return False


def test_agreement_against_brute_force():
    a = drawn(12)
    of = [[images.describe(x[None].astype(np.float32))[1] for x in b] for b in (a, _moved(a, 0.3, 1), _moved(a, 0, 0.8), a[:, 8:52, 4:60])]
    for one in of[0][:6]:
        for two in [c for side in of[1:] for c in side[:6]]:
            assert images.agree(one, two) == brute_agree(one, two)
    assert not images.agree(of[0][0], of[0][0][:0])


def media_of(spark, *sets):
    """Pictures of several sets under ids 10 * k + set."""
    rows = [(10 * k + n, images.encode(x)) for n, pictures in enumerate(sets) for k, x in enumerate(pictures)]
    return spark.createDataFrame(rows, "img long, image binary").repartition(4)


def test_links_of_edited_copies_against_brute_force(spark):
    """Recall of links against all pairs, and of the copies themselves, for each kind of edit."""
    a = drawn(80)
    noise = np.random.default_rng(1).normal(0, 10, a.shape)
    edits = {"cropped": a[:, 6:60, 3:57], "darker": 0.8 * a + 10, "turned": _moved(a, 0.17, 1), "shrunk": _moved(a, 0, 0.8), "enlarged": _moved(a, 0, 1.5), "noisy": a + noise}
    for kind, b in edits.items():
        media = media_of(spark, a, b)
        want = brute_links(media)
        copies = {(10 * k, 10 * k + 1) for k in range(80)}
        got, root = {}, {r["img"]: r["img"] for r in media.collect()}
        for x, y in want:
            root = {k: min(root[x], root[y]) if v in (root[x], root[y]) else v for k, v in root.items()}
        for r in images.copies(media).collect():
            got.setdefault(r["component_id"], []).append(r["img"])
        pairs = {(x, y) for group in got.values() for x in group for y in group if x < y}
        print(f"{kind}: {len(want & copies)} of {len(copies)} copies agree by brute force, {len(pairs & want)} of {len(want)} links found")
        assert len(pairs & want) >= 0.9 * len(want) and len(pairs & copies) >= 0.75 * len(copies)
        assert all(root[x] == root[y] for x, y in pairs) and len(want - copies) <= 10


def test_components_and_counts_do_not_depend_on_full(spark, monkeypatch):
    media = images.render(vectors(spark, 40, close=20))
    root = {r["img"]: r["img"] for r in media.collect()}
    for a, b in brute_links(media):
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    size = Counter(root.values())
    for full, tile in ((2, 5), (24, 4096), (512, 4096)):
        monkeypatch.setattr(images, "FULL", full)
        monkeypatch.setattr(images, "TILE", tile)
        got = {r["img"]: (r["component_id"], r["n_links"]) for r in images.copies(media).collect()}
        assert got == {k: (v, size[v] - 1) for k, v in root.items()}


@pytest.mark.parametrize("crowd", [8, 40])
def test_matches_of_small_and_crowded_buckets_add_up(spark, tmp_path, crowd, monkeypatch):
    """Two pictures share one corner with a crowd and the others with each other alone."""
    monkeypatch.setattr(images, "FULL", 20)
    rng = np.random.default_rng(5)
    bits, place = rng.integers(0, 256, (6, 32), np.uint8), rng.uniform(0, 50, (6, 2))

    def picture(kept):
        out = np.zeros(len(kept), images.CORNER)
        out["bits"], out["x"], out["y"], out["scale"] = bits[kept], place[kept, 0], place[kept, 1], 1
        return out.tobytes()

    rows = [(img, picture([0, 1, 2])) for img in range(crowd)] + [(img, picture([0, 1, 2, 3])) for img in (901, 902)]
    pictures = spark.createDataFrame(rows, "img long, corners binary").coalesce(2)
    alike = spark.createDataFrame([], "a long, b long")
    assert {r["node"]: r["root"] for r in images.linked(pictures, alike, str(tmp_path)).collect()} == {901: 901, 902: 901}


def test_late_pass_against_brute_force():
    rng = np.random.default_rng(8)
    words = rng.integers(-(1 << 62), 1 << 62, (4, 60)).astype(np.int64)
    words[:, 20:] = words[:, rng.integers(0, 20, 40)] ^ (1 << rng.integers(0, 60, 40))
    bucket, root, tile = np.repeat([1, 2, 3], 20), np.sort(rng.integers(0, 6, (3, 20)), axis=1).ravel(), rng.integers(0, 2, 60)
    img, corner = rng.permutation(60), np.arange(60) % 7
    for cross in (False, True):
        a, b, ca = images._late_pass(bucket, img, corner, tile, root, np.full(60, cross), *words)
        want = set()
        for i in range(60):
            for j in range(60):
                far = sum(((int(words[w][i]) ^ int(words[w][j])) % (1 << 64)).bit_count() for w in range(4))
                if bucket[i] == bucket[j] and root[i] < root[j] and far <= images.MAX_HAMMING and not (cross and tile[i] == tile[j]):
                    x, y = (i, j) if img[i] < img[j] else (j, i)
                    want.add((img[x], img[y], corner[x]))
        assert set(zip(a.tolist(), b.tolist(), ca.tolist())) == want and want


def met(a, b):
    """Whether two different corners of a match some of b that share a key with them."""
    width, tables = images.SHORT
    found = {i for i in range(len(a)) for j in range(len(b)) for k in range(tables) if (a["bits"][i] == b["bits"][j])[width * k : width * (k + 1)].all() and np.bitwise_count(a["bits"][i] ^ b["bits"][j]).sum() <= images.MAX_HAMMING}
    return len(found) > 1


def joined(nodes, links):
    root = {k: k for k in nodes}
    for a, b in links:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("full,tile,at_once", [(0, 3, 50), (4, 40, 1000), (1 << 30, 2048, 1 << 19)])
def test_links_of_a_task_against_brute_force(monkeypatch, full, tile, at_once):
    """Pictures, crops and near copies, some ids with two pictures; all pairs, and those of two sides."""
    for name, value in (("FULL", full), ("TILE", tile), ("AT_ONCE", at_once)):
        monkeypatch.setattr(images, name, value)
    a = drawn(14, seed=3)
    pictures = [*a, *a[:4, 6:60, 3:57], *(a[:1] + np.random.default_rng(4).normal(0, 8, (8, 64, 64)))]
    corners = [images.describe(x[None].astype(np.float32))[1] for x in pictures]
    img = np.random.default_rng(6).permutation(26) * 7 % 23  # three ids twice
    of = {k: [corners[n] for n in np.nonzero(img == k)[0]] for k in img.tolist()}
    true = {(x, y) for x in of for y in of if x < y and any(met(p, q) for p in of[x] for q in of[y]) and any(images.agree(p, q) for p in of[x] for q in of[y])}
    side = img % 2
    assert len(set(of)) < 26 and len(true) > 8
    held = [c.tobytes() for c in corners]
    assert joined(of, images._links(False, 0 * side, img, list(held))) == joined(of, true)
    got = images._links(True, side, img, list(held))
    assert set(got) <= true and len(got) == len(of) - len(set(joined(of, got).values()))
    both = joined(of, got)
    assert all(both[x] == both[y] for x, y in true if (x + y) % 2)
    halves = np.arange(26) % 2  # an id may be on both sides
    parts = [*(images._links(False, halves[halves == n], img[halves == n], [h for h, x in zip(held, halves) if x == n]) for n in (0, 1)), images._links(True, halves, img, list(held))]
    assert joined(of, sum(parts, [])) == joined(of, true) and set(img[halves == 0]) & set(img[halves == 1])
    assert images._links(True, 0 * side, img, list(held)) == images._links(True, 0 * side + 1, img, list(held)) == []


def test_only_links_leave_a_task(spark, tmp_path, monkeypatch):
    """Many pictures that share two corners, without a link, and a crowd of copies: what is written grows with the pictures, not with their pairs."""
    rng = np.random.default_rng(7)
    logo = np.zeros(2, images.CORNER)
    logo["bits"], logo["scale"] = rng.integers(0, 256, (2, 32)), 1

    def picture():
        own = np.zeros(8, images.CORNER)
        own["bits"], own["x"], own["y"], own["scale"] = rng.integers(0, 256, (8, 32)), rng.uniform(0, 50, 8), rng.uniform(0, 50, 8), 1
        return own

    crowd = picture()
    rows = [(k, np.concatenate([logo, picture()]).tobytes()) for k in range(120)] + [(k, crowd.tobytes()) for k in range(500, 620)]
    pictures = spark.createDataFrame(rows, "img long, corners binary").repartition(3)
    alike = spark.createDataFrame([], "a long, b long")
    want = {k: 500 for k in range(500, 620)}
    for groups, size in ((5, 24 << 20), (1, 1 << 40), (1, 20_000)):
        monkeypatch.setattr(images, "LEAST_GROUPS", groups)
        monkeypatch.setattr(images, "GROUP", size)
        path = tmp_path / f"{groups}-{size}"
        assert {r["node"]: r["root"] for r in images.linked(pictures, alike, str(path)).collect()} == want
        assert all(spark.read.parquet(str(x)).count() <= 1500 for x in {f.parent for f in path.rglob("*.parquet")})


def test_large_pictures_have_more_corners_and_scales():
    rng = np.random.default_rng(2)
    big = images._box(rng.normal(128, 40, (1, 300, 200)).astype(np.float32), 1) / 9
    _, corners = images.describe(big)
    assert len(set(corners["scale"].tolist())) >= 10 and len(corners) > 400
    _, none = images.describe(np.zeros((1, 300, 200), np.float32))
    assert len(none) == 0
    crop = images.describe(big[:, 100:180, 50:130])[1]
    assert images.agree(corners, crop) and images.agree(crop, corners)
