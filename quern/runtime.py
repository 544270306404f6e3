"""What every module needs from the session: shared storage, table paths, shipping the package to workers."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


#: Rows and bytes that go to a Python worker at once; rows of whole texts are long.
ARROW_ROWS, ARROW_BYTES = "2000", "8m"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep what they hold at once small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    ship_code(spark)


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started; settings stay.

    Nothing is sent where PYTHONPATH names the package's folder already (workers inherit it).
    """
    sc = spark.sparkContext
    home = str(_PACKAGE.parent)
    if home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_quern_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(out))
    sc._quern_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where unset on a local master (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", sc.master):
        raise ValueError(f"spark.checkpoint.dir is unset: on {sc.master} it has to name a folder that driver and executors share")
    if not found:
        found = getattr(sc, "_quern_dir", None) or f"file://{tempfile.mkdtemp(prefix='quern-shared-')}"
        sc._quern_dir = found
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths that this driver has given out; release() deletes them.
_paths: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, below the shared folder."""
    _paths.append(f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def mark() -> int:
    """What release() takes as the begin of a step."""
    return len(_paths)


def release(spark: SparkSession, since: int = 0, *but: DataFrame) -> int:
    """Delete the intermediate tables that this driver has written (since mark(), but for some); call it when results have been stored."""
    kept = {f.rpartition("/")[0].rpartition("/")[2] for df in but for f in df.inputFiles()}
    gone = [p for p in _paths[since:] if p.rpartition("/")[2] not in kept]
    for path in gone:
        drop_path(spark, path)
        _paths.remove(path)
    return len(gone)


#: Spark's setting to remove a query's shuffle files when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Write Parquet; the shuffle files of the query go as soon as it has ended, not when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, source: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from files, kept in the shared folder until the files (or the query on them) change: made where it isn't there yet.

    Its name follows from the files' paths, lengths and times. Writers go to a path of their own and rename it; who
    comes second takes the first one's. A source without files (rows made by the driver) is derived anew each time."""
    paths, jvm, conf = sorted(source.inputFiles()), spark._jvm, spark._jsc.hadoopConfiguration()
    if not paths:
        return written(make(), name)
    seen = hashlib.sha256(f"{source.columns} {source.semanticHash()}\n".encode())
    for f in paths:
        at = jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(conf).getFileStatus(at)
        seen.update(f"{f} {status.getLen()} {status.getModificationTime()}\n".encode())
    path = f"{shared_dir(spark)}/quern-kept/{name}-{seen.hexdigest()[:32]}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        draft = new_path(spark, name)
        write(make(), draft)
        fs.mkdirs(at.getParent())
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(draft), at):
            drop_path(spark, draft)
        _paths.remove(draft)
    return spark.read.parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of written() that no later result reads. Anything that reads more than one folder is passed over."""
    for df in tables:
        folders = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        for path in [p for p in _paths if folders == {p.rpartition("/")[2]}]:
            drop_path(df.sparkSession, path)
            _paths.remove(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of new_path() through Hadoop's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def spread(df: DataFrame, *by: Column) -> DataFrame:
    """A table of fewer splits than the session has cores, dealt to all cores, rows of one key together; any other as it is.

    For work that costs far more than moving the rows; larger tables have splits enough and are never shuffled here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df._jdf.rdd().getNumPartitions() < cores else df


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """`df` with numbers from 1 in the order of a column of unique values, counted range by range instead of in one task."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    part = fresh(df, "part")
    dealt = written(df.repartitionByRange(by).withColumn(part, F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for row in dealt.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect():
        offsets += [F.lit(row[0]), F.lit(before)]
        before += row.n
    start = F.create_map(*offsets)[F.col(part)] if offsets else F.lit(0)
    return dealt.withColumn(name, start + F.row_number().over(Window.partitionBy(part).orderBy(by))).drop(part)


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A broadcast hint if the table is counted to hold `most` rows or fewer; else the table as it is."""
    from pyspark.sql.functions import broadcast

    return broadcast(df) if df.limit(most + 1).count() <= most else df
