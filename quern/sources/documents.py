"""Markdown documents with front-matter as a DataFrame: scan, exclusion, parsing, token costs, rewriting."""

from __future__ import annotations

import json
import os
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import token_estimate
from quern.runtime import new_path, ship
from quern.sources import tree
from quern.sources.frontmatter import parsed

FILE = "SKILL.md"
# Folders that a recursive scan skips, besides hidden ones.
EXCLUDED = """
.git .svn .hg .venv venv env .env __pycache__ .mypy_cache .pytest_cache .ruff_cache node_modules .next .turbo
dist build .build .idea .vscode .DS_Store
""".split()


def guarded(path: str, roots: list[str], spark: SparkSession | None = None) -> str:
    """The path with dots and (of local files) links resolved, if it lies in one of the allowed roots.

    With a session, also if it is a folder that exists."""
    scheme = path[: path.index(":/") + 1] if ":/" in path else ""
    inside = lambda x: x.removeprefix(scheme) if scheme else x
    resolve = os.path.realpath if scheme in ("", "file:") else posixpath.normpath
    real = resolve("/" + inside(path).lstrip("/"))
    if not any(real == (r := resolve("/" + inside(root).lstrip("/"))) or real.startswith(r.rstrip("/") + "/") for root in roots):
        raise ValueError(f"{real} is in none of the allowed roots")
    if spark is not None:
        if not _exists(spark, path):
            raise FileNotFoundError(path)
        if not existing(spark, [path]):
            raise NotADirectoryError(path)
    return real


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _registered(spark: SparkSession) -> None:
    """Make the data source known to a session, and to its workers."""
    ship(spark)
    spark.dataSource.register(tree.Documents)


def _files(spark: SparkSession, root: str, recursive: bool, exclude: list[str]) -> DataFrame | None:
    """(path, content, error) of the files below a folder; None of a missing folder."""
    if not _exists(spark, root):
        return None
    if tree.readable(root):
        _registered(spark)
        reader = spark.read.format(tree.NAME).option("name", FILE).option("exclude", json.dumps([*EXCLUDED, *exclude])).option("recursive", str(recursive).lower())
        return reader.load(root)
    # a store that only Spark's readers open
    reader = spark.read.format("binaryFile").option("pathGlobFilter", FILE)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(root).select("path", "content", F.lit(None).cast("string").alias("error"))
    inside = F.regexp_replace(F.col("path"), "^.*?" + _quoted(posixpath.normpath(root.removeprefix("file://"))) + "/?", "")
    folders = F.slice(F.split(inside, "/"), 1, F.greatest(F.size(F.split(inside, "/")) - 1, F.lit(0)))
    skipped = F.exists(folders, lambda f: f.isin([*EXCLUDED, *exclude]) | f.startswith("."))
    return files.where(~skipped if recursive else ~skipped & (F.size(folders) == 0))


def scan(spark: SparkSession, root: str, recursive: bool = True, exclude: list[str] = ()) -> DataFrame:
    """(path, content) of the documents below a folder, without those that corrupt() lists; a missing folder has none."""
    files = _files(spark, root, recursive, exclude)
    if files is None:
        return spark.createDataFrame([], "path string, content string")
    return files.where(F.is_valid_utf8(F.col("content")) & F.col("error").isNull()).select("path", F.decode("content", "UTF-8").alias("content"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def parse(files: DataFrame, category_root: str = "") -> DataFrame:
    """The catalogue of (path, content): front-matter fields with defaults.

    Name defaults to the folder's, category to the first folder below `category_root` (none if empty)."""
    ship(files.sparkSession)
    content = F.col("content")
    parts = F.split(content, "---", 3)
    framed = content.startswith("---") & (F.size(parts) == 3)
    read = files.withColumn("_head", parsed(F.when(framed, parts[1])))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    below = F.regexp_extract("path", _quoted(category_root) + r"([^/.][^/]*)/", 1) if category_root else F.lit("")
    given = F.coalesce(F.nullif(F.col("_head.category"), F.lit("")), F.lit("uncategorized"))
    out = read.select(
        F.coalesce("_head.name", folder).alias("name"), F.coalesce("_head.description", F.lit("")).alias("description"),
        F.when(framed, F.regexp_replace(parts[2], r"^\s+|\s+$", "")).otherwise(content).alias("body"), "path",
        F.when((given == "uncategorized") & (below != ""), below).otherwise(given).alias("category"), F.coalesce("_head.tags", F.array().cast("array<string>")).alias("tags"),
    )
    return out.withColumn("token_cost_meta", token_estimate(F.concat_ws(" ", "name", "description"))).withColumn("token_cost_body", token_estimate(F.col("body")))


def existing(spark: SparkSession, folders: list[str]) -> list[str]:
    """Those of some candidate folders that are there, in order: where documents may be looked for."""
    out = []
    for path in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.getFileStatus(p).isDirectory():
            out.append(path)
    return out


def corrupt(spark: SparkSession, root: str, recursive: bool = True, exclude: list[str] = ()) -> DataFrame:
    """(path, error) of the documents that scan() leaves out: they can't be read, or aren't UTF-8."""
    bad = _files(spark, root, recursive, exclude)
    if bad is None:
        return spark.createDataFrame([], "path string, error string")
    return bad.where(F.col("error").isNotNull() | ~F.is_valid_utf8(F.col("content"))).select("path", F.coalesce("error", F.lit("not UTF-8")).alias("error"))


def rewritten(docs: DataFrame) -> DataFrame:
    """(path, new_content) of docs(path, content, name, description, tags): the fields patched into the front-matter.

    Text without a closed front-matter gets a new one. Write the result to a new place and swap folders."""
    content = F.col("content")
    parts = F.split(content, "---", 3)
    framed = content.startswith("---") & (F.size(parts) == 3)
    said, tags = F.concat(F.lit("description: "), "description"), F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]"))
    line = lambda x: F.when(x.startswith("description:"), said).when(x.startswith("tags:"), tags).otherwise(x)
    lines = F.split(F.regexp_replace(parts[1], r"^\s+|\s+$", ""), "\n")
    patched = F.concat(F.transform(lines, line), F.when(F.exists(lines, lambda x: x.startswith("description:")), F.array().cast("array<string>")).otherwise(F.array(said)))
    new = F.concat(F.lit("---\nname: "), "name", F.lit("\n"), said, F.lit("\n"), tags, F.lit("\n---\n\n"), content)
    return docs.select("path", F.when(framed, F.concat(F.lit("---\n"), F.array_join(patched, "\n"), F.lit("\n---\n"), parts[2])).otherwise(new).alias("new_content"))


def applied(spark: SparkSession, new: DataFrame, root: str) -> DataFrame:
    """Put (path, new_content) in place of files below `root`; (path, error) of those that couldn't be.

    Tasks write drafts, and once all are there each is renamed over its file: a reader sees one or the other, and a task that
    fails leaves all files as they were."""
    _registered(spark)
    report = new_path(spark, "report")
    new.select("path", "new_content").write.format(tree.NAME).mode("append").option("report", report).save(root)
    schema = "path string, error string"
    return spark.read.schema(schema).json(report) if _exists(spark, report) else spark.createDataFrame([], schema)
