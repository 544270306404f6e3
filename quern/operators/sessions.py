"""Session log: headers derived from events, latest uses, ordered loads, context blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: tokens that a recent name costs in a context block.
CONTEXT_TOKENS = 15


def valid_uses(uses: DataFrame) -> DataFrame:
    """Rows that an append keeps: a session id, and a name that isn't blank; names are trimmed."""
    return uses.where("session_id is not null and cast(session_id as string) <> '' and trim(skill_name) <> ''").withColumn("skill_name", F.trim("skill_name"))


def session_headers(events: DataFrame) -> DataFrame:
    """(session_id, started_at, ended_at, metadata) of start/end events: the first start holds, the last end wins."""
    start, end = (F.when(F.col("event") == x, F.col("timestamp")) for x in ("start", "end"))
    return events.groupBy("session_id").agg(F.min(start).alias("started_at"), F.max(end).alias("ended_at"), F.min_by("metadata", start).alias("metadata"))


def recent_skills(uses: DataFrame, n: int = 5) -> DataFrame:
    """(session_id, place, skill_name, id): the n names used last in each session, newest first, each once."""
    last = uses.groupBy("session_id", "skill_name").agg(F.max("id").alias("id"), F.max_by("timestamp", "id").alias("timestamp"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("timestamp"), F.desc("id")))
    return last.withColumn("place", place).where(F.col("place") <= n).select("session_id", "place", "skill_name", "id")


def load_session(uses: DataFrame) -> DataFrame:
    """(session_id, uses): all uses in order of time; an unknown success stays null."""
    fields = F.struct("timestamp", "id", "skill_name", "query", "success")
    return uses.groupBy("session_id").agg(F.array_sort(F.collect_list(fields)).alias("uses"))


def last_uses(uses: Column, n: int = 5) -> Column:
    """The last n entries of a loaded session, with repetitions, oldest first."""
    return F.slice(uses, F.greatest(F.size(uses) - n + 1, F.lit(1)), F.lit(n))


def latest_session(headers: DataFrame) -> DataFrame:
    """One row: the session started last."""
    return headers.agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("session_id"))


def resolve_session(headers: DataFrame, explicit: str | None = None, active: str | None = None) -> DataFrame:
    """An explicit id, else the active one, else the one started last."""
    return latest_session(headers).select(F.coalesce(F.lit(explicit), F.lit(active), "session_id").alias("session_id"))


def context_block(recent: DataFrame) -> DataFrame:
    """(session_id, names, tokens): recent names as a context block, with its cost."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "skill_name"))), lambda x: x["skill_name"])
    return recent.groupBy("session_id").agg(F.array_join(names, ", ").alias("names"), (F.count("*") * CONTEXT_TOKENS).alias("tokens"))
