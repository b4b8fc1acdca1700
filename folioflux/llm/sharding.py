"""Sharding: a table of immutable shards, compacted by size tiers, under a versioned manifest.

Arrivals are appended as the small files that their tasks write. Shards of a like size (a tier is
a power of `fan_in`) wait until `fan_in` of them have come together; such a run is merged into files of
about the target size. A merge needs no shuffle: Spark's reader packs a run's files into tasks up
to the target, and each task writes one file.

A version is one small file that names a full list of shards and the changes since (shards added and
removed by each commit); every SNAPSHOT_EVERY-th version writes the list anew. So a commit writes as much
as it changes. The version's file is put in its place, whole, by one step that fails if it is there
already: a hard link on local folders, a rename that never replaces elsewhere (one step on HDFS; an
object store without such a rename needs a single writer). Readers see the old version or the new
one, and a writer that lost the race starts again from the newer version.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free

#: Bytes of a full shard, shards of one tier that are merged, bytes below which all share tier 0.
TARGET = 128 << 20
FAN_IN = 4
SMALLEST = 1 << 20
#: Files merged by one job, so that no list of paths grows with the table.
MAX_FILES = 4096
#: Versions from one full list of the shards to the next.
SNAPSHOT_EVERY = 16
#: Seconds for which old versions, and files that no version lists, are kept.
KEEP_SECONDS = 7 * 24 * 3600

MANIFEST = "path string, bytes long, n_rows long, tier int, version long"


class ConcurrentCommit(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Sharded:
    """A table of shards below `root`, in a store that the driver and the executors share."""

    spark: SparkSession
    root: str
    target: int = TARGET
    fan_in: int = FAN_IN
    smallest: int = SMALLEST

    # --- files -------------------------------------------------------------------------------

    def _path(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self) -> Any:
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write_text(self, name: str, text: str) -> None:
        out = self._fs().create(self._path(name), True)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def _read_text(self, name: str) -> str:
        jvm = self.spark._jvm
        found = self._fs().open(self._path(name))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        finally:
            found.close()

    def _put(self, old: str, new: str) -> None:
        """Give a file its name in one step that never replaces another file."""
        jvm, fs = self.spark._jvm, self._fs()
        try:
            if fs.getUri().getScheme() == "file":
                local = lambda name: jvm.java.nio.file.Paths.get(self._path(name).toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(local(new), local(old))
                fs.delete(self._path(old), False)
                return
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context.rename(self._path(old), self._path(new), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise ConcurrentCommit(new) from e
            raise

    # --- versions ----------------------------------------------------------------------------

    def _versions(self) -> list[tuple[int, int]]:
        """(version, when it was committed, in milliseconds), in order."""
        fs, at = self._fs(), self._path("manifests")
        found = fs.listStatus(at) if fs.exists(at) else []
        return sorted((int(x.getPath().getName()[1:]), x.getModificationTime()) for x in found if x.getPath().getName().startswith("v"))

    def version(self) -> int:
        """The newest version; -1 before the first commit."""
        return max((v for v, _ in self._versions()), default=-1)

    def _parts(self, version: int) -> dict[str, Any]:
        """What a version is made of: the folder of a full list (or null), and the changes since."""
        return json.loads(self._read_text(f"manifests/v{version:012d}")) if version >= 0 else {"list": None, "changes": []}

    def _listed(self, parts: dict[str, Any]) -> DataFrame:
        read = self.spark.read.schema(MANIFEST)
        folders = [f"{self.root}/log/{x}/added" for x in [parts["list"], *parts["changes"]] if x]
        if not folders:
            return self.spark.createDataFrame([], MANIFEST)
        gone = [f"{self.root}/log/{x['gone']}/gone" for x in parts.get("merges", [])]
        found = read.parquet(*folders)
        return found.join(self.spark.read.schema("path string").parquet(*gone), "path", "left_anti") if gone else found

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version (MANIFEST), the newest by default; one row a shard."""
        return self._listed(self._parts(self.version() if version is None else version))

    def _commit(self, added: DataFrame, version: int, gone: DataFrame | None = None) -> int:
        """Commit `version`: the one before it with shards added, and others (path) gone."""
        parts, name = self._parts(version - 1), uuid.uuid4().hex
        added.select("path", "bytes", "n_rows", "tier", "version").write.parquet(f"{self.root}/log/{name}/added")
        parts = {"list": parts["list"], "changes": [*parts["changes"], name], "merges": parts.get("merges", [])}
        if gone is not None:
            gone.select("path").write.parquet(f"{self.root}/log/{name}/gone")
            parts["merges"] = [*parts["merges"], {"gone": name}]
        if len(parts["changes"]) >= SNAPSHOT_EVERY:
            whole = uuid.uuid4().hex
            self._listed(parts).write.parquet(f"{self.root}/log/{whole}/added")
            parts = {"list": whole, "changes": [], "merges": []}
        self._fs().mkdirs(self._path("manifests"))
        self._write_text(f"log/{name}/version", json.dumps(parts))
        self._put(f"log/{name}/version", f"manifests/v{version:012d}")
        return version

    def _shards(self, folder: str, version: int) -> DataFrame:
        """What the manifest says of the files in a folder: sizes from the listing, row counts from
        the Parquet footers (no column is read)."""
        sizes = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.root}/{folder}").select("path", F.col("length").alias("bytes"))
        counts = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))
        tier = F.when(F.col("bytes") <= self.smallest, 0).otherwise(F.floor(F.log(F.col("bytes") / F.lit(float(self.smallest))) / F.log(F.lit(float(self.fan_in)))) + 1)
        found = sizes.join(counts, "path", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))  # an empty table's file carries its schema
        return found.select("path", "bytes", "n_rows", tier.cast("int").alias("tier"), F.lit(version).cast("long").alias("version"))

    def _begun(self, folder: str) -> None:
        """Tell vacuum() of other writers that a folder is being written."""
        self._write_text(f"pending/{folder.rpartition('/')[2]}", "")

    def _ended(self, folder: str) -> None:
        self._fs().delete(self._path(f"pending/{folder.rpartition('/')[2]}"), False)

    # --- operations --------------------------------------------------------------------------

    def append(self, arrivals: DataFrame) -> int:
        """Add rows as new shards, as their tasks write them (map only); the new version.

        Any rows and columns will do: nulls, repeats, ties and very long texts are stored as they
        are, and an empty table adds one shard without rows, which carries the schema.
        """
        folder = f"shards/{uuid.uuid4().hex}"
        self._begun(folder)
        arrivals.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        while True:
            v = self.version()
            try:
                self._commit(self._shards(folder, v + 1), v + 1)
            except ConcurrentCommit:
                continue
            self._ended(folder)
            return v + 1

    def runs(self, manifest: DataFrame) -> DataFrame:
        """(path, bytes, tier): the shards of tiers that have come to fan_in of them.

        Shards of over half the target are full: two of them would not fit in one file.
        """
        waiting = manifest.filter(F.col("bytes") * 2 <= self.target)
        ripe = waiting.groupBy("tier").agg(F.count("*").alias("n")).filter(F.col("n") >= self.fan_in)
        return waiting.join(F.broadcast(ripe), "tier").select("path", "bytes", "tier")  # tiers: a few dozen at most

    def _packer(self) -> SparkSession:
        """A session of its own, whose reader packs files into tasks of the target's size."""
        own = self.spark.newSession()
        for key, value in (("maxPartitionBytes", self.target), ("minPartitionNum", 1), ("openCostInBytes", 0)):
            own.conf.set(f"spark.sql.files.{key}", str(value))
        return own

    def compact(self) -> int:
        """Merge ripe runs, tier by tier, until none is left; the version after the last merge.

        Each job merges up to MAX_FILES shards of one tier, in the order of their paths.
        """
        packer, met = self._packer(), set()
        while True:
            v = self.version()
            manifest = self.manifest(v)
            tiers = [r["tier"] for r in self.runs(manifest).select("tier").distinct().orderBy("tier").collect()]
            tier = next((t for t in tiers if t not in met), None)
            if tier is None:
                return v
            files = [r["path"] for r in self.runs(manifest).filter(F.col("tier") == tier).select("path").orderBy("path").limit(MAX_FILES).collect()]
            if len(files) < MAX_FILES:
                met.add(tier)  # what a merge leaves of a tier isn't merged again in this call
            folder = f"shards/{uuid.uuid4().hex}"
            self._begun(folder)
            packer.read.parquet(*files).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            try:
                self._commit(self._shards(folder, v + 1), v + 1, self.spark.createDataFrame([(x,) for x in files], "path string"))
            except ConcurrentCommit:
                self._fs().delete(self._path(folder), True)
                met.discard(tier)
            self._ended(folder)

    def vacuum(self, keep_seconds: float = KEEP_SECONDS, lease_seconds: float = 4 * KEEP_SECONDS) -> None:
        """Delete versions older than keep_seconds but the newest, and what no version left lists.

        Files younger than that stay, and those of folders that another writer has begun and not
        yet committed; a writer that died leaves such a mark, which counts for lease_seconds.
        A folder may hold live shards beside merged ones, so shards go file by file.
        """
        fs, path, now = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path, time.time() * 1000
        old = now - keep_seconds * 1000
        versions = self._versions()
        left = [(v, at) for k, (v, at) in enumerate(versions) if at >= old or k == len(versions) - 1]
        for v, _ in versions[: len(versions) - len(left)]:
            fs.delete(self._path(f"manifests/v{v:012d}"), False)
        parts = [self._parts(v) for v, _ in left]
        used = {x for p in parts for x in [p["list"], *p["changes"], *[m["gone"] for m in p.get("merges", [])]]}
        stale = lambda name, by: [x for x in (fs.listStatus(self._path(name)) if fs.exists(self._path(name)) else []) if x.getModificationTime() < by]
        for x in stale("log", old):
            if x.getPath().getName() not in used:
                fs.delete(x.getPath(), True)
        for x in stale("pending", now - lease_seconds * 1000):
            fs.delete(x.getPath(), False)
        begun = [x.getPath().getName() for x in stale("pending", float("inf"))]
        if not fs.exists(self._path("shards")):
            return
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.root}/shards/*").select("path", "modificationTime")
        files = files.filter(F.unix_millis("modificationTime") < int(old)).filter(~F.element_at(F.split("path", "/"), -2).isin(begun))
        for p in parts:
            files = files.join(self._listed(p).select("path"), "path", "left_anti")
        for r in files.toLocalIterator():
            fs.delete(path(r["path"]), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: of the very files that it lists. The driver holds their paths, as
        Spark's own file index does."""
        files = [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        if not files:
            raise ValueError("nothing has been committed")
        return self.spark.read.parquet(*files)

    def assignments(self, id_col: str) -> DataFrame:
        """(id, path, and the manifest's columns) for every row of the newest version.

        The id keeps its name, in front; where a column of the manifest has that name, the
        manifest's gets an underscore in front. Null and repeated ids have their rows too.
        """
        v = self.version()
        listed = self.manifest(v)
        for c in listed.columns:
            listed = listed.withColumnRenamed(c, free(c, [id_col]))
        path = free("path", [id_col])
        return self.read(v).select(F.col(id_col), F.col("_metadata.file_path").alias(path)).join(listed, path).select(id_col, *listed.columns)


def waves(df: DataFrame, id_col: str, n: int) -> list[DataFrame]:
    """n arrivals by ranges of the id, so that the reader skips row groups of other arrivals.

    Rows with a null id come with the first; rows that share an id stay together.
    """
    low, high = df.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return [df]
    step = max(1, -(-(high - low + 1) // n))
    at = F.col(id_col)
    parts = [df.filter((at >= low + k * step) & (at < low + (k + 1) * step)) for k in range(n) if low + k * step <= high]
    parts[0] = df.filter((at < low + step) | at.isNull())
    return parts
