"""Usage analytics over the append-only event log; the point in time is always an argument."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_events(events: DataFrame) -> DataFrame:
    """Rows that an append keeps: a name that isn't blank."""
    return events.where("trim(skill_name) <> ''")


def since(events: DataFrame, as_of: datetime.datetime, days: int = 30) -> DataFrame:
    """Events later than `days` days before `as_of`."""
    return events.where(F.col("timestamp") > F.lit(as_of - datetime.timedelta(days=days)))


def daily_stats(events: DataFrame) -> DataFrame:
    """(date, queries, skills_loaded, tokens_saved, avg_latency_ms) by day."""
    return events.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("queries"), F.count("*").alias("skills_loaded"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"), F.avg("latency_ms").alias("avg_latency_ms")
    )


def running_latency(events: DataFrame) -> DataFrame:
    """Each event with its day's mean latency so far."""
    so_far = Window.partitionBy(F.to_date("timestamp")).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("running_avg", F.avg("latency_ms").over(so_far))


def top_skills(events: DataFrame, n: int = 10) -> DataFrame:
    return events.groupBy("skill_name").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "skill_name").limit(n)


def by_method(events: DataFrame) -> DataFrame:
    return events.groupBy("retrieval_method").agg(F.count("*").alias("cnt"))


def tokens_saved(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.sum("tokens_saved"), F.lit(0)).cast("long").alias("tokens_saved"))


def unused(catalogue: DataFrame, events: DataFrame, n: int = 20) -> DataFrame:
    """Names never used: a null-aware NOT IN, so one null among the used names leaves none."""
    spark = catalogue.sparkSession
    return spark.sql(
        "SELECT name FROM {c} WHERE name NOT IN (SELECT DISTINCT skill_name FROM {e}) ORDER BY rowid, name LIMIT {n}",
        c=catalogue.select("name", "rowid"), e=events.select("skill_name"), n=n,
    )


def insights(events: DataFrame, catalogue: DataFrame, as_of: datetime.datetime, days: int = 30) -> dict[str, DataFrame]:
    """All reports of a period; the list of unused names covers the whole log."""
    part = since(events, as_of, days)
    daily = daily_stats(events).where(F.col("date") > F.lit((as_of - datetime.timedelta(days=days)).date()))
    return {
        "total": part.agg(F.count("*").alias("total_queries")), "top_skills": top_skills(part), "methods": by_method(part),
        "tokens": tokens_saved(part), "daily": daily.orderBy("date"), "unused": unused(catalogue, events),
    }
