"""Catalogue sinks as views over loads: merging upsert, cascaded delete, recipes, JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import percent, score_bar


def upsert(loads: DataFrame) -> DataFrame:
    """One row by name of loads(load_seq, name, ..., tags): the last load's fields, with the sorted union of all tags."""
    last = Window.partitionBy("name").orderBy(F.desc("load_seq"))
    newest = loads.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "tags")
    first = loads.groupBy("name").agg(F.min("load_seq").alias("rowid"))
    tags = loads.select("name", F.explode_outer("tags").alias("tag")).distinct().groupBy("name").agg(F.array_sort(F.collect_list("tag")).alias("tags"))  # a name's distinct tags, however many loads
    return newest.join(tags, "name").join(first, "name").drop("load_seq")


def without(table: DataFrame, removed: DataFrame, key: str = "name") -> DataFrame:
    """A table without removed names; the same call on dependent tables makes the delete cascade."""
    return table.join(removed.select(F.col("name").alias(key)).distinct(), key, "left_anti")


def by_use(table: DataFrame, uses: DataFrame, category: str | None = None) -> DataFrame:
    """The catalogue with use_count, from uses(skill_name): the most used first, then in order of rowid; of one category, or of all."""
    counts = uses.groupBy(F.col("skill_name").alias("name")).agg(F.count("*").alias("use_count"))
    rows = table if category is None else table.where(F.col("category") == category)
    return rows.join(counts, "name", "left").withColumn("use_count", F.coalesce("use_count", F.lit(0))).orderBy(F.desc("use_count"), "rowid")


def as_text(results: DataFrame) -> DataFrame:
    """(qid, rank, line): results (qid, rank, name, description, tags, score, method, meta and body tokens) as a person reads them."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join(F.slice("tags", 1, 2), ", "), F.lit("]"))).otherwise(F.lit(""))
    costs = F.concat(F.lit("~"), F.col("token_cost_meta").cast("string"), F.lit("t meta / ~"), F.col("token_cost_body").cast("string"), F.lit("t body"))
    bar = F.concat(F.lit("["), score_bar(F.col("score")), F.lit("] "), percent(F.col("score")).cast("string"), F.lit("% | "), "method", F.lit(" | "), costs)
    head = F.concat(F.col("rank").cast("string"), F.lit(". "), "name")
    return results.select("qid", "rank", F.concat_ws("\n", head, F.concat(F.col("description"), tags), bar).alias("line"))


def recipe(recipes: DataFrame, catalogue: DataFrame, name: str, include_should: bool = True) -> DataFrame:
    """(pos, name, tokens, total_tokens): a recipe's documents in order, those that the catalogue has."""
    wanted = F.concat("must", "should") if include_should else F.col("must")
    listed = recipes.where(F.col("recipe") == name).select(F.posexplode(wanted).alias("pos", "name"))
    found = listed.join(catalogue.select("name", F.col("token_cost_body").alias("tokens")), "name")
    return found.select("pos", "name", "tokens").withColumn("total_tokens", F.sum("tokens").over(Window.partitionBy()))


def newest_recipes(log: DataFrame) -> DataFrame:
    """Of an append-only log of recipes with ids, each name's last one."""
    every = [c for c in log.columns if c not in ("id", "recipe")]
    last = log.groupBy("recipe").agg(F.max(F.struct("id", *every)).alias("x"))
    return last.select("x.id", "recipe", *[f"x.{c}" for c in every])


def save_recipe(recipes: DataFrame, new: DataFrame) -> DataFrame:
    """Recipes with new ones added or put in place of their namesakes."""
    return recipes.join(new.select("recipe"), "recipe", "left_anti").unionByName(new)


def as_json(results: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return results.select(F.to_json(F.struct("*")).alias("json"))
