"""Job 1: the usage report. From a usage log, what each day's retrievals were, what they saved, and which names were used most.

    spark-submit jobs/usage_report.py --events LOG --output FOLDER [--config jobs/usage_report.json]

Output: FOLDER/days and FOLDER/skills, Parquet, partitioned by date.

- days: queries, distinct names, tokens saved, mean latency, change of queries against the day before.
- skills: of each day, name and retrieval method: queries, tokens saved, latency, share of the day's queries, rank of the name in its day.

Settings: `from` and `to` (dates, the latter excluded) rewrite only those days, after late events for example: their partitions are
replaced and others stay. Days that the range holds but the log doesn't have no partition to write, and an earlier one stays; a run without
a range replaces everything. Either way a second run over the same log gives the same files' rows.

Rows without a time, or with a blank name, are left out as the engine's log leaves them out. Nothing but one row
a day and name is shuffled (partial sums first), whatever share of the log one name has."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.common import log, main, observed  # noqa: E402
from quern.operators import usage  # noqa: E402
from quern.sources import adapters  # noqa: E402

DEFAULTS = {"from": None, "to": None}


def in_range(events: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Events of the days from `first` up to `last`, the latter excluded."""
    if first:
        events = events.where(F.col("timestamp") >= F.lit(first).cast("date").cast("timestamp_ntz"))
    if last:
        events = events.where(F.col("timestamp") < F.lit(last).cast("date").cast("timestamp_ntz"))
    return events


def by_skill(events: DataFrame) -> DataFrame:
    """(date, skill_name, retrieval_method, queries, tokens_saved, latency_ms, share, place) of each day."""
    sums = events.groupBy(F.to_date("timestamp").alias("date"), "skill_name", "retrieval_method").agg(
        F.count("*").alias("queries"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"), F.round(F.avg("latency_ms"), 6).alias("latency_ms")
    )
    # one row a name and method is left of each day: windows over these are small
    day, name = Window.partitionBy("date"), Window.partitionBy("date", "skill_name")
    sums = sums.withColumn("of_name", F.sum("queries").over(name)).withColumn("share", F.round(F.col("queries") / F.sum("queries").over(day), 6))
    return sums.withColumn("place", F.dense_rank().over(day.orderBy(F.desc("of_name"), "skill_name"))).drop("of_name")


def by_day(events: DataFrame, before: DataFrame) -> DataFrame:
    """Each day's totals; `before` has the events from a day earlier on, so that the first day has a day before it too."""
    totals = usage.daily_stats(events).select("date", "queries", "tokens_saved", F.round("avg_latency_ms", 6).alias("avg_latency_ms"))
    names = events.groupBy(F.to_date("timestamp").alias("date")).agg(F.count_distinct("skill_name").alias("skills"))
    last = before.groupBy(F.date_add(F.to_date("timestamp"), 1).alias("date")).agg(F.count("*").alias("n"))
    return totals.join(names, "date").join(last, "date", "left").withColumn("change", F.col("queries") - F.coalesce("n", F.lit(0))).drop("n")


def run(spark: SparkSession, events: str, output: str, config: dict = DEFAULTS) -> dict[str, int]:
    """Write the report; returns rows read and written."""
    config = DEFAULTS | config
    first, last = config["from"], config["to"]
    every = usage.valid_events(adapters.usage_log(spark.read.parquet(events))).where("timestamp is not null")
    chosen, seen = observed(in_range(every, first, last), "read")
    # only the days of a range are replaced; without one, all
    mode = "dynamic" if first or last else "static"

    def write(rows: DataFrame, table: str) -> int:
        rows, count = observed(rows, table)
        rows.repartition("date").sortWithinPartitions("date").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("date").parquet(f"{output}/{table}")
        return count.get["rows"]

    counts = {"skills": write(by_skill(chosen), "skills"), "read": seen.get["rows"]}
    earlier = F.date_sub(F.lit(first).cast("date"), 1).cast("timestamp_ntz") if first else None
    counts["days"] = write(by_day(in_range(every, first, last), in_range(every.where(F.col("timestamp") >= earlier) if first else every, None, last)), "days")
    log.info("usage_report: read %d events of %s (days from %s up to %s); wrote %d rows to %s/skills and %d to %s/days", counts["read"], events, first, last, counts["skills"], output, counts["days"], output)
    return counts


def output(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables read back as one: each row of skills with its day's totals."""
    days = spark.read.parquet(f"{folder}/days").select("date", F.col("queries").alias("day_queries"), F.col("skills").alias("day_skills"), F.col("tokens_saved").alias("day_tokens"), F.col("avg_latency_ms").alias("day_latency"), F.col("change").alias("day_change"))
    return spark.read.parquet(f"{folder}/skills").join(days, "date")


if __name__ == "__main__":
    main(run, DEFAULTS, ["events", "output"], "usage_report")
