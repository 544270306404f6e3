"""Selection from ranked lists: thresholds, token budgets, elbow cuts, diversity. All are windows over (qid, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold(results: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows of a score of `least` or more; no filter unless it is positive."""
    return results.where(F.col("score") >= least) if least > 0 else results


def budgeted(results: DataFrame, budget: int = 500) -> DataFrame:
    """The longest prefix of results(qid, rank, tokens) within the budget, without rows of over twice the budget.

    The first such row stays even if it alone exceeds it; if none is left, the first of all."""
    order = Window.partitionBy("qid").orderBy("rank")
    fit = results.where(F.col("tokens") <= 2 * budget)
    fit = fit.withColumn("_sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_no", F.row_number().over(order))
    kept = fit.where((F.col("_no") == 1) | (F.col("_sum") <= budget)).select(results.columns)
    first = results.withColumn("_no", F.row_number().over(order)).where("_no = 1").select(results.columns)
    return kept.unionByName(first.join(kept.select("qid").distinct(), "qid", "left_anti"))


def elbow(results: DataFrame, least: int = 1, most: int = 10, ratio: float = 2.0) -> DataFrame:
    """(qid, k, n, found): how many of results(qid, rank, score) to take, cut at the first largest gap if it stands out.

    k = 0 where no gap exists among several results (a vague query)."""
    order = Window.partitionBy("qid").orderBy("rank")
    gaps = results.withColumn("_no", F.row_number().over(order)).withColumn("_gap", F.col("score") - F.lead("score").over(order))
    stats = gaps.groupBy("qid").agg(
        F.count("*").alias("n"), F.avg("_gap").alias("mean"), F.max("_gap").alias("largest"), F.max("score").alias("top"),
        F.max(F.struct("_gap", (-F.col("_no")).alias("no"))).alias("at"),
    )
    cut = F.when((F.col("largest") >= F.col("mean") * ratio) & (F.col("largest") >= 0.05 * F.col("top")), -F.col("at.no")).otherwise(F.col("n"))
    k = F.when(F.col("n") <= least, F.col("n")).when(F.col("mean") <= 0, 0).otherwise(F.greatest(F.lit(least), F.least(cut, F.lit(most))))
    return stats.select("qid", k.cast("long").alias("k"), "n", (k < F.col("n")).alias("found"))


def adaptive(results: DataFrame, least: int = 1, most: int = 10, ratio: float = 2.0) -> DataFrame:
    """The results that elbow() says to take."""
    return results.join(elbow(results, least, most, ratio).select("qid", "k"), "qid").where(F.col("rank") <= F.col("k")).select(results.columns)


def diverse(results: DataFrame, top_k: int = 5, per_category: int = 2) -> DataFrame:
    """At most two results of a category, then the first top_k; top_k of one or less changes nothing."""
    if top_k <= 1:
        return results
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized"))
    of_category = Window.partitionBy("qid", category).orderBy("rank")
    out = results.withColumn("_in", F.row_number().over(of_category)).where(F.col("_in") <= per_category)
    out = out.withColumn("_no", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return out.where(F.col("_no") <= top_k).select(results.columns)
