"""The names used last in each session, kept in state by session: a batch reads its own rows and the state of its own sessions, no log.

State holds a row for each name of an open session. A session that isn't used for `gap` of event time is over: a timer deletes its
state. Every change is appended as one row (session_id, last_id, names); a session's last row counts. Rows of a session that comes back after it
was over begin it anew."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session_id string, last_id bigint, names array<struct<skill_name:string,id:bigint>>"
#: Spark's setting for where state lives; keyed state with timers needs this one.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RecentNames(StatefulProcessor):
    """`n` names at most are given out; `gap` in milliseconds."""

    def __init__(self, n: int, gap: int):
        self.n, self.gap = n, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "skill_name string", "id bigint, at bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        over = self.timer.get()
        before = limit = over[0] if over is not None else None
        for r in sorted(rows, key=lambda r: (r.timestamp, r.id)):  # one batch's rows of one session
            at = int(r.timestamp.timestamp() * 1_000_000)
            if limit is not None and at // 1000 > limit:
                self.names.clear()  # it was over, though no timer has said so yet
            limit = max(limit or 0, at // 1000 + self.gap)
            known = self.names.getValue((r.skill_name,))
            if known is None or r.id > known[0]:
                self.names.updateValue((r.skill_name,), (r.id, at))
        if limit != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.timer.update((limit,))
            self.handle.registerTimer(limit)
        found = sorted(((value[1], value[0], name[0]) for name, value in self.names.iterator()), reverse=True)
        yield Row(session_id=key[0], last_id=max(x[1] for x in found), names=[Row(skill_name=x[2], id=x[1]) for x in found[: self.n]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.names.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def recent_names(uses: DataFrame, n: int = 5, gap: datetime.timedelta = datetime.timedelta(days=1), late: str = "1 hour") -> DataFrame:
    """(session_id, last_id, names) after each batch of a stream of uses(id, session_id, skill_name, timestamp)."""
    rows = uses.select("id", F.col("session_id").cast("string").alias("session_id"), "skill_name", F.col("timestamp").cast("timestamp").alias("timestamp"))
    processor = RecentNames(n, int(gap.total_seconds() * 1000))
    return rows.withWatermark("timestamp", late).groupBy("session_id").transformWithState(processor, OUTPUT, "update", "EventTime")


def kept(uses: DataFrame, view: str, checkpoint: str, **options):
    """Take in what a stream has and keep the view's changes; returns the query, which ends when all is taken in."""
    spark = uses.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        write = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(view)
        return recent_names(uses, **options).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def recent_skills(spark: SparkSession, view: str) -> DataFrame:
    """(session_id, place, skill_name, id), as sessions.recent_skills() has it, of each session's last change."""
    changes = spark.read.schema(f"{OUTPUT}, batch bigint").parquet(view)
    last = changes.groupBy("session_id").agg(F.max_by("names", "batch").alias("names"))
    return last.select("session_id", F.posexplode("names").alias("pos", "x")).select("session_id", (F.col("pos") + 1).alias("place"), "x.skill_name", "x.id")
