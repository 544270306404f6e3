"""Rank fusion and re-scoring of results(qid, rank, name, score, method). Each function keeps ranks explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import hinted
from quern.runtime import bounded

# The fusion constant, the penalty without a hint, mixing weights.
RRF_K, PENALTY, SESSION_BOOST, MIX = 60, 0.7, 0.5, 0.3


def reranked(results: DataFrame, *ties: str) -> DataFrame:
    """New ranks by score; earlier ranks break ties, so the order is stable."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *(ties or ("rank",)), "name")
    return results.withColumn("rank", F.row_number().over(order))


def rrf(lists: list[DataFrame], queries: DataFrame, docs: DataFrame, top_k: int = 20, threshold: float = 0.0) -> DataFrame:
    """Fuse ranked lists (qid, rank, name) by sum of 1 / (RRF_K + rank); a row that neither name nor description hints at is penalised.

    Ties go by the first list's order, then the second's."""
    every = None
    for k, x in enumerate(lists):
        one = x.select("qid", "name", (1.0 / (RRF_K + F.col("rank"))).alias("part"), F.lit(k).alias("list"), F.col("rank").alias("at"))
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy("qid", "name").agg(F.sum("part").alias("score"), F.min(F.struct("list", "at")).alias("first"))
    fused = fused.join(docs.select("name", "description"), "name").join(bounded(queries), "qid")
    hint = hinted(F.col("query"), F.col("name"), F.col("description"), least=2)
    score = F.when(hint, F.col("score")).otherwise(F.col("score") * PENALTY)
    order = Window.partitionBy("qid").orderBy(F.desc("full"), "first", "name")
    out = fused.withColumn("full", score).withColumn("rank", F.row_number().over(order)).withColumn("score", F.round("full", 4))
    out = out.where((F.col("score") >= threshold) if threshold > 0 else F.lit(True)).where(F.col("rank") <= top_k)
    return out.select("qid", "rank", "name", "score", F.lit("bm25+embed").alias("method"))


def session_boost(results: DataFrame, recent: DataFrame, boost: float = SESSION_BOOST) -> DataFrame:
    """Add `boost` to names in recent(name)."""
    flag = F.col("boosted").isNotNull()
    out = results.join(recent.select("name").distinct().withColumn("boosted", F.lit(True)), "name", "left")
    out = out.withColumn("score", F.when(flag, F.round(F.col("score") + boost, 4)).otherwise(F.col("score"))).withColumn("method", F.when(flag, F.concat("method", F.lit("+session"))).otherwise(F.col("method")))
    return reranked(out.drop("boosted")).select(results.columns)


def _mixed(results: DataFrame, other: DataFrame, value: str, suffix: str, weight: float, positive: bool) -> DataFrame:
    out = results.join(other.select("name", F.col(value).alias("_other")), "name", "left")
    use = (F.col("_other") > 0) if positive else F.col("_other").isNotNull()
    score = F.round(F.col("score") * (1 - weight) + F.col("_other") * weight, 4)
    out = out.withColumn("score", F.when(use, score).otherwise(F.col("score"))).withColumn("method", F.when(use, F.concat("method", F.lit(suffix))).otherwise(F.col("method")))
    return reranked(out.drop("_other")).select(results.columns)


def graph_boost(results: DataFrame, ppr: DataFrame, weight: float = MIX) -> DataFrame:
    """Mix in ppr(name, score) where it is positive."""
    return _mixed(results, ppr.withColumnRenamed("score", "ppr"), "ppr", "+graph", weight, True)


def feedback_weighted(results: DataFrame, weights: DataFrame, weight: float = MIX) -> DataFrame:
    """Mix in weights(skill_name, base_weight) where a row exists."""
    return _mixed(results, weights.select(F.col("skill_name").alias("name"), "base_weight"), "base_weight", "+weighted", weight, False)
