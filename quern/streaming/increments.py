"""Incremental views of the logs: daily statistics, name weights, recent names by session. State is bounded by watermarks or keys;
views that depend on the order of the whole log are derived from it anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import learning, sessions


def daily_stats(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days with late rows for `late`; update or append mode."""
    out = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 day"))
    return out.agg(F.count("*").alias("queries"), F.sum("tokens_saved").alias("tokens_saved"), F.avg("latency_ms").alias("avg_latency_ms")).select(F.to_date("window.start").alias("date"), "queries", "tokens_saved", "avg_latency_ms")


def skill_weights(feedback: DataFrame) -> DataFrame:
    """Counters and Beta means by name; update or complete mode."""
    yes = F.count_if("success")
    out = feedback.groupBy("skill_name").agg(yes.alias("successes"), (F.count("*") - yes).alias("failures"))
    return out.withColumn("base_weight", (F.col("successes") + 1) / (F.col("successes") + F.col("failures") + 2))


def auto_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by gap, for users without explicit session ids."""
    out = events.withWatermark("timestamp", late).groupBy("user_id", F.session_window("timestamp", gap))
    return out.agg(F.count("*").alias("uses")).select("user_id", "session_window.start", "session_window.end", "uses")


def last_use(uses: DataFrame) -> DataFrame:
    """When each session used a name last. Update mode."""
    return uses.groupBy("session_id", "skill_name").agg(F.max("timestamp").alias("timestamp"), F.max("id").alias("id"))


def refreshed(stream: DataFrame, log: str, view: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame]):
    """A view derived from a whole log, anew with each batch of a stream that the log takes in; returns the query.

    A batch stands in a folder of its own number, so one that is run again after a failure counts once. The view's
    folder of a batch is complete when it has a _SUCCESS file; newest() finds the last."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        derive(spark.read.parquet(log).drop("batch")).write.mode("overwrite").parquet(f"{view}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, view: str) -> DataFrame:
    """The last complete folder of a view of refreshed()."""
    path = spark._jvm.org.apache.hadoop.fs.Path(view)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [p for f in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p := f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(str(max(done, key=lambda p: int(p.getName().partition("=")[2])).toString()))


def query_patterns(stream: DataFrame, log: str, view: str, checkpoint: str):
    """Which name serves a kind of query best, as learning.query_patterns() has it, kept up with a feedback stream.

    A pattern's best name depends on the rates of names over all patterns in order, so the fold goes over the log."""
    return refreshed(stream, log, view, checkpoint, learning.query_patterns)


def recent_skills(stream: DataFrame, log: str, view: str, checkpoint: str, n: int = 5):
    """The last n names of each session, kept up with a stream of uses."""
    return refreshed(stream, log, view, checkpoint, lambda uses: sessions.recent_skills(uses, n))


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """An append-only Parquet log of a stream, exactly once; returns the query."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
