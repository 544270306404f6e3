"""Entity deduplication of names that arrive in batches: what has been signed is never signed again.

Tables below `root`, partitioned by batch: `names` (rowid, name, normal form), `bands` (band number, key, rowid) of names that pass the
entropy gate, one row of each name, and `links` (a, b) of rows of one entity. An arrival signs its own names, meets the stored bands and normal forms
in equi-joins, and appends. Entities are the components of all links; of those there are as many as duplicates, not as names.

A batch that is run again writes the same partition again, whatever came after it: rows of later batches don't take part in it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import is_prefix_pair, is_variant_pair
from quern.functions.unicode import jaro_winkler, normal_name_exact
from quern.operators import entities
from quern.operators.components import components
from quern.runtime import written

SCHEMAS = {"names": "rowid bigint, name string, norm string", "bands": "no int, key string, rowid bigint", "links": "a bigint, b bigint"}


class Arrivals:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, table: str, before: int | None = None) -> DataFrame:
        """A table, or what batches before one have written."""
        schema = f"{SCHEMAS[table]}, batch int"
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[table])
        return (found if before is None else found.where(F.col("batch") < before)).drop("batch")

    def _write(self, table: str, batch: int, rows: DataFrame) -> None:
        rows.withColumn("batch", F.lit(batch)).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{table}")

    def add(self, names: DataFrame, batch: int) -> None:
        """Take in names(rowid, name) of new rowids; batches are numbered upwards."""
        new = written(names.select("rowid", "name", normal_name_exact(F.col("name")).alias("norm")), "arrived")
        old = self._read("names", batch)
        # rows of one normal form: each with the form's first row
        same = new.select("norm").distinct()
        first = old.join(same, "norm", "left_semi").unionByName(new).groupBy("norm").agg(F.min("rowid").alias("a"))
        ties = old.join(same, "norm", "left_semi").unionByName(new).join(first, "norm").where("a < rowid").select("a", F.col("rowid").alias("b"))
        # similar names: one row of each name is signed, and none of a name that has been
        once = new.groupBy("name").agg(F.min("rowid").alias("rowid")).join(old.select("name").distinct(), "name", "left_anti").select("rowid", "name")
        bands = written(entities.bands(entities.signatures(once)), "bands")
        every = self._read("bands", batch).unionByName(bands)
        pairs = bands.withColumnRenamed("rowid", "x").join(every.withColumnRenamed("rowid", "y"), ["no", "key"]).where("x <> y")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        norms = old.unionByName(new)
        side = lambda x: norms.select(F.col("rowid").alias(x), F.col("norm").alias(f"n{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(~is_variant_pair(F.col("na"), F.col("nb")) & ~is_prefix_pair(F.col("na"), F.col("nb")))
        near = both.where(jaro_winkler(F.col("na"), F.col("nb")) >= entities.MERGE).select("a", "b")
        self._write("links", batch, ties.unionByName(near).distinct())
        self._write("bands", batch, bands)
        self._write("names", batch, new)

    def survivors(self) -> DataFrame:
        """(rowid, name, survivor), as entities.survivors() has it for all names together."""
        names = self._read("names").drop("norm")
        found = components(self._read("links"))
        return names.join(found, names.rowid == found.node, "left").select("rowid", "name", F.coalesce("component", "rowid").alias("survivor"))
