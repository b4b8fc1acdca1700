"""Copies among images by local descriptors: found also where they are cropped or edited.

Corners are found at several scales, more of them on larger pictures; each gets a direction (its
patch's intensity centroid) and 256 binary tests of smoothed intensities at points turned by that
direction; corners that look like a plain slope tell nothing and are left out. Two images are linked when enough of their corners match under one motion: descriptors up
to MAX_HAMMING bits apart vote for scale, turn and shift.

Pairs of images to compare come from Hamming tables. Descriptors that share a key are compared over
all bits, and two images with two different corners that match are candidates; they are then compared
by all of their corners, exactly. The images are dealt into groups of bounded size, and a task has two
groups with all of their corners: it builds the tables, compares and confirms on the spot, and only
links leave it, one for each two components that it joins. In buckets of more than FULL descriptors (one
picture with very many copies) the first one is compared with the others before all are compared with
all; what is one component already is not compared again, so many copies cost little, and no pair that
the keys hold is missed.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, lookup_join, small_batches, trim, written
from .components import components

#: From one scale to the next; scales go on while a patch fits.
STEP = 1.5**0.5
#: Corners kept at a scale: so many for each 64 x 64 pixels, between these bounds.
DENSITY = 14
LEAST_CORNERS = 4
MOST_CORNERS = 400
#: Half a patch's side; directions told apart.
REACH = 9
TURNS = 36
BITS = 256
#: Hamming tables: bytes of the descriptor that are a key, and tables.
SHORT = (3, 10)
#: Bytes of corners in a group of images, about; and groups at least, so that small tables are spread over some tasks too.
GROUP = 24 << 20
LEAST_GROUPS = 5
#: Numbers of steps between groups that meet by one shuffle.
ROUND = 3
#: Descriptors of a pair of corners differ in this many bits at most.
MAX_HAMMING = 44
#: Spots that must agree on one motion; the motion's cell, in pixels for pictures up to 64 pixels wide; and a spot's side.
MIN_VOTES = 4
CELL = 10.0
SPOT = 10.0
SHARE = 0.25
#: Buckets of more members than this are first compared with their first member; all with all, up to the square of TILE pairs go together.
FULL = 24
TILE = 2048
#: Pairs of descriptors compared at once.
AT_ONCE = 1 << 19

#: A corner: its descriptor, place, scale and direction.
CORNER = np.dtype([("bits", "u1", BITS // 8), ("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4")])
DESCRIBED = "img long, sha string, corners binary"
LINKS = "a long, b long"


def decode(data: bytes | None) -> np.ndarray | None:
    """A binary PGM or PPM (8 bits) as grey levels; None for anything else, or null."""
    head = re.match(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data or b"")
    if not head or int(head[4]) > 255:
        return None
    deep, wide, high = 1 if head[1] == b"5" else 3, int(head[2]), int(head[3])
    pixels = np.frombuffer(data, np.uint8, offset=head.end())
    if not wide or not high or len(pixels) < deep * wide * high:
        return None
    return pixels[: deep * wide * high].reshape(high, wide, deep).mean(axis=2, dtype=np.float32)


def encode(grey: np.ndarray) -> bytes:
    """Grey levels as a binary PGM."""
    return f"P5\n{grey.shape[1]} {grey.shape[0]}\n255\n".encode() + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _tests() -> np.ndarray:
    """For each direction the 256 pairs of points, as whole pixels: (TURNS, 2, BITS, 2)."""
    rng = np.random.default_rng(256)
    points = np.clip(rng.normal(0, REACH / 2.2, (2, BITS, 2)), -REACH + 3, REACH - 3)
    turn = 2 * np.pi * np.arange(TURNS) / TURNS
    c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    y, x = points[..., 0][None], points[..., 1][None]
    return np.stack([np.rint(s * x + c * y), np.rint(c * x - s * y)], axis=-1).astype(np.int64)


TESTS = _tests()
#: The descriptor of a plain slope, which all smooth patches have once they are turned.
SLOPE = np.packbits(TESTS[0, 0, :, 1] < TESTS[0, 1, :, 1])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1, edges repeated; a is (images, high, wide)."""
    p = np.pad(a, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").astype(np.float64)
    total = p.cumsum(axis=1).cumsum(axis=2)
    d = 2 * r + 1
    return (total[:, d:, d:] - total[:, :-d, d:] - total[:, d:, :-d] + total[:, :-d, :-d]).astype(np.float32)


def _smaller(a: np.ndarray, scale: float) -> np.ndarray:
    """Images reduced by a factor, bilinear."""
    if scale == 1:
        return a
    high, wide = int(a.shape[1] / scale), int(a.shape[2] / scale)
    y, x = np.clip((np.arange(high) + 0.5) * scale - 0.5, 0, a.shape[1] - 1.001), np.clip((np.arange(wide) + 0.5) * scale - 0.5, 0, a.shape[2] - 1.001)
    i, j = y.astype(int), x.astype(int)
    v, u = (y - i)[None, :, None].astype(np.float32), (x - j)[None, None, :].astype(np.float32)
    top = a[:, i][:, :, j] * (1 - u) + a[:, i][:, :, j + 1] * u
    low = a[:, i + 1][:, :, j] * (1 - u) + a[:, i + 1][:, :, j + 1] * u
    return top * (1 - v) + low * v


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of same-sized images (n, high, wide): the image's number, and CORNER, image by image."""
    numbers: list[np.ndarray] = []
    out: list[np.ndarray] = []
    grid, scale = np.arange(-6, 7), 1.0
    while min(images.shape[1:]) / scale >= 2 * REACH + 4:
        a = _smaller(images, scale)
        n, high, wide = a.shape
        most = min(MOST_CORNERS, max(LEAST_CORNERS, round(high * wide / 4096 * DENSITY)))
        gy, gx = np.gradient(a, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strong = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        strong[:, :REACH], strong[:, -REACH:], strong[:, :, :REACH], strong[:, :, -REACH:] = 0, 0, 0, 0
        peak = strong > 1e-3
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if dy or dx:
                    peak &= strong >= np.roll(strong, (dy, dx), axis=(1, 2))
        value = np.where(peak, strong, 0).reshape(n, -1)
        best = np.argsort(-value, axis=1, kind="stable")[:, :most]
        img, k = np.nonzero(np.take_along_axis(value, best, axis=1) > 0)
        at = best[img, k]
        y, x = at // wide, at % wide
        patch = a[img[:, None, None], y[:, None, None] + grid[None, :, None], x[:, None, None] + grid[None, None, :]]
        round_ = (grid[:, None] ** 2 + grid[None, :] ** 2 <= 36).astype(np.float32)
        angle = np.arctan2((patch * round_ * grid[:, None]).sum(axis=(1, 2)), (patch * round_ * grid[None, :]).sum(axis=(1, 2)))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        smooth = _box(a, 1)
        pairs = TESTS[turn]  # corners, 2, BITS, (y, x)
        py, px = y[:, None, None] + pairs[..., 0], x[:, None, None] + pairs[..., 1]
        seen = smooth[img[:, None, None], py, px]
        found = np.zeros(len(img), CORNER)
        found["bits"] = np.packbits(seen[:, 0] < seen[:, 1], axis=1)
        found["x"], found["y"], found["scale"], found["angle"] = (x + 0.5) * scale, (y + 0.5) * scale, scale, angle
        telling = np.bitwise_count(found["bits"] ^ SLOPE).sum(axis=1, dtype=np.int16) > MAX_HAMMING
        numbers.append(img[telling])
        out.append(found[telling])
        scale *= STEP
    if not out:
        return np.zeros(0, int), np.zeros(0, CORNER)
    number, corners = np.concatenate(numbers), np.concatenate(out)
    order = np.argsort(number, kind="stable")
    return number[order], corners[order]


def descriptors(media: DataFrame, img: str = "img", image: str = "image") -> DataFrame:
    """(img, sha, corners): a row for every image, with its bytes' digest. One pass, no shuffle.

    A null, empty or unreadable image, one that is too small for a patch, or a flat one, has no
    corners; a null one has the digest of no bytes.
    """
    small_batches(media.sparkSession, rows=256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same_size, out = defaultdict(list), [b""] * batch.num_rows
            for k, data in enumerate(batch.column(2).to_pylist()):
                if (grey := decode(data)) is not None:
                    same_size[grey.shape].append((k, grey))
            for group in same_size.values():
                for at in range(0, len(group), 32):
                    part = group[at : at + 32]
                    number, corners = describe(np.stack([g for _, g in part]))
                    ends = np.searchsorted(number, np.arange(len(part) + 1))
                    for j, (k, _) in enumerate(part):
                        out[k] = corners[ends[j] : ends[j + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["img", "sha", "corners"])
        trim()

    rows = media.select(F.col(img).cast("long").alias("img"), F.sha2(F.coalesce(F.col(image), F.lit(b"")), 256).alias("sha"), F.col(image).alias("image"))
    return rows.mapInArrow(run, DESCRIBED)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the descriptors of two images' corners differ: (corners of a, corners of b)."""
    x, y = (np.ascontiguousarray(c["bits"]).view(np.uint64) for c in (a, b))
    return np.bitwise_count(x[:, None] ^ y[None]).sum(axis=-1, dtype=np.int16)


def agree(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether corners at MIN_VOTES spots of image a match some of image b under one motion (CORNER arrays).

    A match votes for a change of scale, a turn and a shift, in cells that overlap by half. A
    turn's error moves a shift in proportion to its distance, so the cells grow with the picture.
    Corners of several scales at one spot (a square of SPOT pixels) count once: they see the same.
    Where many spots match by chance, SHARE of them have to agree (of those of the image with fewer).
    """
    i, j = np.nonzero(_far(a, b) <= MAX_HAMMING)
    if len(np.unique(i)) < MIN_VOTES:
        return False
    p, q = a[i], b[j]
    spot, there = (np.floor(c["x"] / SPOT).astype(np.int64) << 32 | np.floor(c["y"] / SPOT).astype(np.int64) for c in (p, q))
    least = max(MIN_VOTES, SHARE * min(len(np.unique(spot)), len(np.unique(there))))
    size = q["scale"] / p["scale"]
    turn = (q["angle"] - p["angle"]).astype(np.float64)
    cell = CELL * max(1.0, float(max(p["x"].max(), p["y"].max(), q["x"].max(), q["y"].max())) / 64)
    shift_x = (q["x"] - size * (np.cos(turn) * p["x"] - np.sin(turn) * p["y"])) / cell
    shift_y = (q["y"] - size * (np.sin(turn) * p["x"] + np.cos(turn) * p["y"])) / cell
    steps, turns = np.log(size) / (2 * np.log(STEP)), turn * 6 / np.pi
    for k in range(16):
        half = [0.5 * (k >> n & 1) for n in range(4)]
        motion = np.stack([np.floor(steps + half[0] + 0.25), np.floor(turns + half[1]) % 12, np.floor(shift_x + half[2]), np.floor(shift_y + half[3]), spot], axis=1).astype(np.int64)
        motion = np.unique(motion, axis=0)  # a spot votes once for a motion
        same = np.any(np.diff(motion[:, :4], axis=0) != 0, axis=1)
        if np.diff(np.concatenate([[-1], np.nonzero(same)[0], [len(motion) - 1]])).max() >= least:
            return True
    return False


def _own(spark: SparkSession) -> SparkSession:
    """A session of its own, that removes the files of each job's shuffles when the job has ended."""
    own = spark.newSession()
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
        own.conf.set(key, spark.conf.get(key))
    small_batches(own)
    return own


def copies(media: DataFrame, img: str = "img", image: str = "image") -> DataFrame:
    """(img, component_id, n_links) for every row: the least id among an image's copies.

    component_id is the image's own id if it has no copy. n_links: the other images of its
    component, linked with it directly or through others. Exact copies are collapsed by their
    bytes before any corner is sought. Null ids give a row with a null component; repeated ids
    give a row each, and all images under one id count as that id's: each is compared. An empty
    table gives no rows; other columns are not read, whatever their names.
    """
    spark = media.sparkSession
    path = fresh_dir(spark, "images")
    written(descriptors(media, img, image), f"{path}/descriptors")
    own = _own(spark)
    described = own.read.schema(DESCRIBED).parquet(f"{path}/descriptors")
    named = described.select("img", "sha").filter("img is not null")
    first = named.groupBy("sha").agg(F.min("img").alias("rep"), F.count("*").alias("n"))
    # Digests held by one image only are their own representatives; the others, however many rows they have, are looked up.
    again = written(first.filter("n > 1"), f"{path}/again")
    same = written(lookup_join(named, again, ["sha"], "n").select("img", "rep").distinct(), f"{path}/same")
    pictures = described.filter("img is not null and length(corners) > 0").join(same.filter("img <> rep").select("img"), "img", "left_anti")
    # Images under one id are pictures of their own here, and one node of the components.
    pictures = written(pictures.dropDuplicates(["img", "sha"]).select("img", "corners"), f"{path}/pictures")
    alike = same.filter("img <> rep").select(F.col("rep").alias("a"), F.col("img").alias("b"))
    roots = linked(pictures, alike, path)
    sizes = written(roots.groupBy("root").agg(F.count("*").alias("size")), f"{path}/sizes")
    known = lookup_join(roots, sizes, ["root"], "size").select(F.col("node").alias("img"), "root", (F.col("size") - 1).alias("n_links"))
    written(known, f"{path}/known")
    known = spark.read.schema("img long, root long, n_links long").parquet(f"{path}/known")
    rows = spark.read.schema(DESCRIBED).parquet(f"{path}/descriptors").select("img")
    found = rows.filter("img is not null").join(known, "img", "left").select("img", F.coalesce("root", "img").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found.unionByName(rows.filter("img is null").select("img", F.col("img").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def linked(pictures: DataFrame, alike: DataFrame, path: str) -> DataFrame:
    """(node, root): components of pictures (img, corners) by their corners, and by the links (a, b) of exact copies.

    Each two groups of images meet in one task, a group and the one so many steps on, for ROUND numbers
    of steps in a shuffle; so a shuffle has two copies of the table a step at most. Many images under
    one id are dealt out like any others.
    """
    held = pictures.agg(F.sum(F.length("corners"))).first()[0] or 0
    groups = max(LEAST_GROUPS, math.ceil(held / GROUP))
    pictures = pictures.withColumn("own", F.pmod(F.xxhash64("img", "corners"), F.lit(groups)).cast("int"))
    parts = []
    for k in range(0, groups // 2 + 1, ROUND):
        steps = range(k, min(groups // 2 + 1, k + ROUND))
        # (steps, side): the groups' first ones, then those that they meet; none but themselves at no steps
        places = F.array(*[F.struct(F.lit(d).alias("step"), F.lit(side).alias("side")) for d in steps for side in (0, 1)[: 1 + (d > 0)]])
        rows = pictures.withColumn("place", F.explode(places)).select("img", "corners", "place.*", F.pmod(F.col("own") - F.col("place.step") * F.col("place.side"), F.lit(groups)).alias("first"))
        rows = rows.filter((F.col("step") * 2 < groups) | (F.col("first") < F.col("step")))  # halfway round, each two groups would meet twice
        rows = rows.select(((F.col("step") - k) * groups + F.col("first")).cast("int").alias("task"), (F.col("step") > 0).alias("cross"), "side", "img", "corners")
        parts.append(f"{path}/links-{k}")
        written(rows.repartitionById(groups * len(steps), "task").select("cross", "side", "img", "corners").mapInArrow(_task, LINKS), parts[-1])
    return components(pictures.sparkSession.read.schema(LINKS).parquet(*parts).unionByName(alike), f"{path}/roots")


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links among the images of one task."""
    cross, side, img, held = False, [], [], []
    for batch in batches:
        if batch.num_rows:
            cross = batch.column(0)[0].as_py()
            side.append(batch.column(1).to_numpy(zero_copy_only=False))
            img.append(batch.column(2).to_numpy(zero_copy_only=False))
            held += batch.column(3).to_pylist()
    if held:
        links = _links(cross, np.concatenate(side), np.concatenate(img), held)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
    trim()


def _links(cross: bool, side: np.ndarray, img: np.ndarray, held: list[bytes]) -> list[tuple[int, int]]:
    """Links (a, b) that join the components of images; if cross, only pairs of images of two sides are all compared.

    Nodes are ids in their order. Rows are corners, by side and id: those of a node are together there, whatever its pictures. held is emptied.
    """
    order = np.lexsort((img, side))
    ids, node = np.unique(img, return_inverse=True)
    sizes = np.array([len(held[k]) // CORNER.itemsize for k in order], np.int64)
    corners = np.frombuffer(b"".join(held[k] for k in order), CORNER)
    held.clear()
    node, ends = node[order], sizes.cumsum()
    pictures = defaultdict(list)
    for k, n in enumerate(node.tolist()):
        pictures[n].append(slice(ends[k] - sizes[k], ends[k]))
    n_first = int(sizes[side[order] == 0].sum()) if cross else len(corners)  # rows of the first side
    node = np.repeat(node, sizes)
    corner = np.arange(len(node))
    words = list(np.ascontiguousarray(np.ascontiguousarray(corners["bits"]).view(np.int64).T))
    parent, links = list(range(len(ids))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def confirm(a: np.ndarray, b: np.ndarray, ca: np.ndarray) -> None:
        """Links the nodes with two different corners that match, if they agree by all their corners."""
        if not len(a):
            return
        pair = a.astype(np.int64) * len(ids) + b
        by = np.argsort(pair)
        pair, ca = pair[by], ca[by]
        at, _ = _buckets(pair)
        for code in pair[at[np.minimum.reduceat(ca, at) != np.maximum.reduceat(ca, at)]].tolist():
            x, y = divmod(code, len(ids))
            if (p := find(x)) != (q := find(y)) and any(agree(corners[i], corners[j]) for i in pictures[x] for j in pictures[y]):
                parent[max(p, q)] = min(p, q)
                links.append((int(ids[x]), int(ids[y])))

    if not n_first or cross and n_first == len(node):
        return []  # one side is empty
    for k in range(SHORT[1]):
        confirm(*_lead_pass(_keys(corners, k), node, corner, *words))
    root = np.array([find(x) for x in range(len(ids))])
    after = n_first if cross else 0  # the other side's first row
    tables, weight = [], np.zeros(n_first, np.int64)
    for k in range(SHORT[1]):
        key = _keys(corners, k)
        code = key << 32 | root[node]
        by = np.argsort(code[after:])
        there = code[after:][by]
        mine = np.argsort(code[:n_first]) if cross else by
        own = code[mine]  # in order, as it is looked up faster
        key = own >> 32 << 32
        weight[mine] += np.searchsorted(there, key + (1 << 32)) - np.searchsorted(there, key) - np.searchsorted(there, own, "right") + np.searchsorted(there, own)
        tables.append(((there >> 32).astype(np.int32), (by + after).astype(np.int32)))
    for s, e in _blocks(weight, node[:n_first]):
        root = np.array([find(x) for x in range(len(ids))])
        found = []
        for k, (there, by) in enumerate(tables):
            key = _keys(corners[s:e], k)
            wanted = np.unique(key).astype(np.int32)
            lo, hi = np.searchsorted(there, wanted), np.searchsorted(there, wanted, "right")
            other = by[_ranges(lo, hi)]
            bucket = np.concatenate([key, np.repeat(wanted, hi - lo)])
            row = np.concatenate([np.arange(s, e), other])
            tile = np.repeat([0, 1], [e - s, len(other)])
            if not cross:  # what stands before has been compared
                keep = row >= s
                bucket, row, tile = bucket[keep], row[keep], tile[keep]
            to = np.argsort(bucket << 32 | root[node[row]])
            bucket, row, tile = bucket[to], row[to], tile[to]
            found.append(_late_pass(bucket, node[row], corner[row], tile, root[node[row]], np.ones(len(row), bool), *[w[row] for w in words]))
        confirm(*(np.concatenate(x) for x in zip(*found)))
    return links


def _keys(corners: np.ndarray, k: int) -> np.ndarray:
    """The corners' keys in one of the tables."""
    width = SHORT[0]
    return corners["bits"][:, width * k : width * (k + 1)].astype(np.int64) @ (1 << 8 * np.arange(width, dtype=np.int64))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers from each lo to its hi, one after the other."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - n.cumsum() + n, n)


def _blocks(weight: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of whole nodes, whose weights sum up to the square of TILE at most if it is more than one node; without those that have none."""
    starts, _ = _buckets(node)
    ends = np.append(starts[1:], len(node))
    total = weight.cumsum()[ends - 1]
    at, done = 0, 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(total, done + TILE * TILE, "right")))
        if total[upto - 1] > done:
            yield int(starts[at]), int(ends[upto - 1])
        at, done = upto, int(total[upto - 1])


def _close(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows whose descriptors differ in MAX_HAMMING bits at most."""
    far = np.zeros(len(i), np.int16)
    for w in range(4):
        far += np.bitwise_count((words[w][i] ^ words[w][j]).view(np.uint64))  # of signed numbers it counts the absolute value's bits
        keep = far <= MAX_HAMMING
        i, j, far = i[keep], j[keep], far[keep]
    return i, j


def _named(img: np.ndarray, corner: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, ca) of pairs of rows: the smaller image first, and its corner."""
    i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, int) for k in (0, 1))
    i, j = np.where(img[i] < img[j], i, j), np.where(img[i] < img[j], j, i)
    return img[i], img[j], corner[i]


def _buckets(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket begins, and its size."""
    starts = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1])
    return starts, np.diff(np.concatenate([starts, [len(bucket)]]))


def _lead_pass(bucket: np.ndarray, img: np.ndarray, corner: np.ndarray, *words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of the first row of each bucket of more than FULL rows with the other images' rows in it; rows in any order."""
    by = np.argsort(bucket, kind="stable")
    starts, size = _buckets(bucket[by])
    lead, full = by[np.repeat(starts, size)], np.repeat(size > FULL, size)
    keep = full & (img[by] != img[lead])
    return _named(img, corner, [_close(words, lead[keep], by[keep])])


def _late_pass(bucket: np.ndarray, img: np.ndarray, corner: np.ndarray, tile: np.ndarray, root: np.ndarray, cross: np.ndarray, *words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches between rows of different roots; where two tiles (0 and 1) meet, only those between the tiles.

    Rows are in the order of their buckets and roots; each is compared with the bucket's others
    before and after those of its root.
    """
    if not len(bucket):
        return _named(img, corner, [])
    new = np.diff(bucket) != 0
    group = np.concatenate([[0], new.cumsum()])
    run = np.concatenate([[0], (new | (np.diff(root) != 0)).cumsum()])
    pairs = []
    one, two = np.nonzero(~cross)[0], np.nonzero(~cross)[0]
    pairs += _spans(words, one, two, np.searchsorted(run[two], run[one], "right"), np.searchsorted(group[two], group[one], "right"))
    one, two = np.nonzero(cross & (tile == 0))[0], np.nonzero(cross & (tile != 0))[0]
    pairs += _spans(words, one, two, np.searchsorted(group[two], group[one]), np.searchsorted(run[two], run[one]))
    pairs += _spans(words, one, two, np.searchsorted(run[two], run[one], "right"), np.searchsorted(group[two], group[one], "right"))
    return _named(img, corner, pairs)


def _spans(words: tuple[np.ndarray, ...], one: np.ndarray, two: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row of one with its span of two, the pairs that match; some AT_ONCE pairs at a time."""
    total = (hi - lo).cumsum()
    at = 0
    while at < len(one):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        yield _close(words, np.repeat(one[at:upto], (hi - lo)[at:upto]), two[_ranges(lo[at:upto], hi[at:upto])])
        at = upto


# --- pictures from vectors: the media column of tables that have none -----------------------------

SIDE = 64


def _patterns(dims: int) -> np.ndarray:
    """A smooth random pattern for each dimension: (dims, SIDE, SIDE)."""
    noise = np.random.default_rng(64).normal(size=(dims, SIDE + 8, SIDE + 8)).astype(np.float32)
    for _ in range(2):
        noise = _box(noise, 1) / 9
    noise = noise[:, 4:-4, 4:-4]
    return noise / noise.std(axis=(1, 2), keepdims=True)


def render(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", copies_of: int = 10) -> DataFrame:
    """(img, image): each vector drawn as a picture, binary PGM.

    Of each run of `copies_of` ids the second is drawn as a crop of the first one's picture, and the
    third as the first one's, darker and with less contrast; so a part of the table is known to
    be cropped or edited copies. Null ids are left out; a null vector, or one with a null or another
    size than the first of its batch, is drawn flat.
    """
    small_batches(vectors.sparkSession, rows=512)
    own = vectors.select(F.col(vec_id).cast("long").alias("img"), F.col(embedding).cast("array<float>").alias("v")).filter("img is not null")
    edit = F.pmod("img", F.lit(copies_of))
    base = own.filter(edit == 0).groupBy("img").agg(F.min("v").alias("base")).withColumnRenamed("img", "of")
    # The others look up their own id: no null key, which would gather them in one task.
    drawn = own.withColumn("of", F.when(edit.isin(1, 2), F.col("img") - edit).otherwise(F.col("img"))).join(base, "of", "left")
    kind = F.when(edit.isin(1, 2) & F.col("base").isNotNull(), edit).otherwise(0).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for v, kind in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                grey = np.full((SIDE, SIDE), 128, np.float32)
                if v and None not in v:
                    if len(v) not in basis:
                        basis.clear()
                        basis[len(v)] = _patterns(len(v)).reshape(len(v), -1)
                    grey = 128 + 40 * (np.array(v, np.float32) @ basis[len(v)]).reshape(SIDE, SIDE)
                if kind == 1:
                    grey = grey[6:60, 3:57]
                elif kind == 2:
                    grey = 0.8 * grey + 10
                out.append(encode(grey))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["img", "image"])

    return drawn.select("img", F.when(kind > 0, F.col("base")).otherwise(F.col("v")).alias("v"), kind.alias("kind")).mapInArrow(run, "img long, image binary")
