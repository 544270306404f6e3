"""Operator 9 [native]: size-tiered compaction of document shards under a versioned manifest, in DataFrame operations alone.

A store is a folder: data/<run> holds the immutable Parquet shards of one append or merge, manifests/<name> tables of the
shards of one version, and versions/<number> small files that name a manifest. append() adds an arrival as a run of small
shards. compact() merges runs of similar size (their bytes within a factor of RATIO, wherever those lie) once there are
FAN_IN of them, into a run of files of about the target size, without a shuffle: a task reads whole shards and writes one
file. Runs whose shards are large enough already rest. Each step writes a new folder only and then commits the next version
by one rename that fails if the number is taken; the loser looks at the new version and tries again. So readers see all of a
step or nothing, and lost executors or drivers leave at most folders that no version names. vacuum() deletes those once they
are older than a period of grace, which spares appends that haven't committed yet.

The driver sees one row for each run, not for each shard; a version is read by its runs' folders.

Rows are kept as they are: nulls in any column, repeated rows and ids, extra columns of any name, texts of any length. An
empty arrival commits a version with no new shard, and an empty table gives an empty result. A row larger than the target
makes a larger file. Committing work whose folder has been vacuumed fails.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import bounded, new_path, write

TARGET_BYTES, FAN_IN, RATIO = 64 << 20, 4, 2.0
#: Seconds for which a folder that no version names is spared.
GRACE = 24 * 3600
#: Columns of a manifest.
MANIFEST = "run string, path string, bytes long, rows long"
ATTEMPTS = 20


class Store:
    """Shards of one table below `root`."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        top = self._path(self.root)
        self.fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = hadoop.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list:
        at = self._path(f"{self.root}/{folder}")
        return list(self.fs.listStatus(at)) if self.fs.exists(at) else []

    def version(self) -> int:
        """The latest committed version; 0 of an empty store."""
        return max((int(n) for f in self._listed("versions") if (n := f.getPath().getName()).isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        named = self.fs.open(self._path(f"{self.root}/versions/{version:012d}"))
        name = named.readLine()
        named.close()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def runs(self, version: int | None = None) -> list[tuple[str, int, int]]:
        """(run, shards, bytes) of a version: a row for each append that hasn't been merged, and for each merge."""
        found = self.manifest(version).groupBy("run").agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes"))
        return [tuple(x) for x in found.orderBy("bytes", "run").collect()]

    def commit(self, shards: DataFrame, after: int) -> int:
        """Make `shards` version `after` + 1; fails if another writer has."""
        name = uuid.uuid4().hex
        write(shards.select("run", "path", "bytes", "rows"), f"{self.root}/manifests/{name}")
        draft, final = self._path(f"{self.root}/versions/.{name}"), self._path(f"{self.root}/versions/{after + 1:012d}")
        out = self.fs.create(draft, False)
        out.writeBytes(f"{name}\n")
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self.context.rename(draft, final, options)  # atomic; throws where the version exists
        return after + 1

    def _change(self, change: Callable[[DataFrame], DataFrame | None], new: list[str]) -> int:
        """Commit a change of the latest version, again from the start where another writer was first; None: no change any more."""
        for _ in range(ATTEMPTS):
            before = self.version()
            after = change(self.manifest(before))
            if after is None:
                return before
            if lost := [x for x in new if not self.fs.exists(self._path(f"{self.root}/data/{x}"))]:
                raise RuntimeError(f"runs vacuumed before their commit: {lost}")
            try:
                return self.commit(after, before)
            except Exception as e:
                if "AlreadyExists" not in str(e) or self.version() == before:
                    raise
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    def _measured(self, run: str, like: DataFrame) -> DataFrame:
        """Manifest rows of the shards in a run's folder: sizes from the files' metadata, rows from their footers."""
        at = self.spark.read.schema(like.schema).parquet(f"{self.root}/data/{run}")
        sizes = at.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.max("_metadata.file_size").alias("bytes"), F.count("*").alias("rows"))
        return sizes.select(F.lit(run).alias("run"), "path", "bytes", "rows")

    def append(self, arrival: DataFrame) -> int:
        """Add rows as a run of small shards, one for each task; returns the version."""
        run = uuid.uuid4().hex
        arrival.write.option("compression", "zstd").parquet(f"{self.root}/data/{run}")
        shards = self._measured(run, arrival)
        return self._change(lambda before: before.unionByName(shards), [run])

    def due(self) -> list[list[tuple[str, int, int]]]:
        """Groups of runs to merge: FAN_IN or more of similar bytes, whose shards are below the target."""
        small = [x for x in self.runs() if x[1] > 1 and x[2] / x[1] < self.target / 2 or x[1] == 1 and x[2] < self.target / 2]
        groups, at = [], 0
        while at < len(small):  # by size; the smallest run that has enough others beside it opens a group
            end = at
            while end < len(small) and small[end][2] <= RATIO * small[at][2]:
                end += 1
            if end - at >= self.fan_in:
                groups.append(small[at:end])
                at = end
            else:
                at += 1
        return groups

    def compact(self) -> int:
        """Merge until no group is due; returns the version. Old runs stay for readers of old versions until vacuum()."""
        while groups := self.due():
            for group in groups:
                old, run = [x[0] for x in group], uuid.uuid4().hex
                files = max(1, math.ceil(sum(x[2] for x in group) / self.target))
                merged = self.spark.read.parquet(*[f"{self.root}/data/{x}" for x in old])
                merged.coalesce(files).write.option("compression", "zstd").parquet(f"{self.root}/data/{run}")
                shards, there = self._measured(run, merged), F.col("run").isin(old)

                def swap(before: DataFrame) -> DataFrame | None:
                    if before.where(there).select("run").distinct().count() < len(old):
                        return None  # another writer has merged some of them
                    return before.where(~there).unionByName(shards)

                self._change(swap, [run])
        return self.version()

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        folders = [f"{self.root}/data/{run}" for run, *_ in self.runs(version)]
        if not folders:
            raise ValueError("the version has no shards")
        return self.spark.read.parquet(*folders)

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Delete runs that none of the last `keep` versions names and that are older than `grace` seconds; returns their number."""
        last, now = self.version(), time.time()
        folders = [f.getPath().getName() for f in self._listed("data") if now - f.getModificationTime() / 1000 >= grace]  # before the versions are read
        live = {run for v in range(max(1, last - keep + 1), self.version() + 1) for run, *_ in self.runs(v)}
        dead = [x for x in folders if x not in live]
        for run in dead:
            self.fs.delete(self._path(f"{self.root}/data/{run}"), True)
        return len(dead)


def sharded(docs: DataFrame, arrivals: int = 4, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(doc_id, version, shard, shard_rows, shard_bytes, text_sha256): every document, from the compacted store.

    Documents arrive in `arrivals` lots of one commit each, by a hash of their id, and the store is compacted when all have come; a shard
    is named by its run and file. A null text has a null hash."""
    spark = docs.sparkSession
    store = Store(spark, new_path(spark, "store"), target_bytes)
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(lot == k))
    version = store.compact()
    shards = store.manifest(version)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, version long, shard string, shard_rows long, shard_bytes long, text_sha256 string")
    rows = store.read(version).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
    named = shards.select("path", F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    return rows.join(bounded(named), "path").select("doc_id", F.lit(version).cast("long").alias("version"), "shard", "shard_rows", "shard_bytes", "text_sha256")
