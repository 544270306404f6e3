"""Feedback: weights, rates and query patterns, all derived from the append-only log."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import pattern_key
from quern.runtime import ship, written


def skill_weights(feedback: DataFrame) -> DataFrame:
    """(skill_name, base_weight, successes, failures, last_updated): the mean of a Beta posterior by name."""
    yes = F.count_if(F.coalesce("success", F.lit(False)))
    out = feedback.groupBy("skill_name").agg(yes.alias("successes"), (F.count("*") - yes).alias("failures"), F.max("timestamp").alias("last_updated"))
    return out.select("skill_name", ((F.col("successes") + 1) / (F.col("successes") + F.col("failures") + 2)).alias("base_weight"), "successes", "failures", "last_updated")


def top_rates(weights: DataFrame, n: int = 10) -> DataFrame:
    """The names of the best success rates."""
    rate = F.col("successes") / F.greatest(F.col("successes") + F.col("failures"), F.lit(1))
    return weights.where("successes + failures > 0").select("skill_name", "successes", "failures", F.round(rate, 3).alias("rate"), rate.alias("_r")).orderBy(F.desc("_r"), "skill_name").limit(n).drop("_r")


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """One row: totals, success rate, numbers of patterns and names."""
    key = F.nullif(pattern_key(F.col("query")), F.lit(""))
    yes = F.count_if("success")
    return feedback.agg(F.count("*").alias("total_feedback"), F.round(yes / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"), F.count_distinct(key).alias("query_patterns"), F.count_distinct("skill_name").alias("skills_with_feedback"))


def running_counters(feedback: DataFrame) -> DataFrame:
    """The log with each name's successes and uses so far, the row itself included."""
    so_far = Window.partitionBy("skill_name").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return feedback.withColumn("s", F.sum(F.col("success").cast("long")).over(so_far)).withColumn("n", F.count("*").over(so_far))


def query_patterns(feedback: DataFrame) -> DataFrame:
    """(pattern_key, best_skill, count, last_used): which name serves a kind of query best, learnt in order of the log.

    The first name holds a new pattern; a success of another name takes over if its success rate, as counted over all
    patterns up to then, is strictly better. A pattern's names bring their counters of other patterns along, so the
    history of the names that the pattern has seen passes by, in order and in one task; no more than the names' last rates are held."""
    ship(feedback.sparkSession)
    log = running_counters(feedback).withColumn("pattern_key", pattern_key(F.col("query"))).select("id", "skill_name", "success", "timestamp", "pattern_key", (F.col("s") / F.col("n")).alias("rate"))
    names = written(log.where("pattern_key <> ''").select(F.col("pattern_key").alias("of"), "skill_name").distinct(), "pattern-names")
    history = log.join(names, "skill_name").select("of", "id", "skill_name", "success", "timestamp", "pattern_key", "rate")
    return history.repartition("of").sortWithinPartitions("of", "id").mapInArrow(_folded, "pattern_key string, best_skill string, count long, last_used timestamp_ntz")


def _folded(it):
    """A pattern's history passes by in order; only its names' last rates are held."""
    of, rates, best, count, last = None, {}, None, 0, None
    done = []

    def out():
        cols = list(zip(*done, strict=True))
        return pa.record_batch([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.timestamp("us"))], names=["pattern_key", "best_skill", "count", "last_used"])

    for batch in it:
        for key, _, name, success, at, pattern, rate in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != of:
                if of is not None:
                    done.append((of, best, count, last))
                of, rates, best, count, last = key, {}, None, 0, None
            rates[name] = rate
            if pattern == key:
                if best is None or success and name != best and rate > rates[best]:
                    best = name
                count, last = count + 1, at
        if len(done) >= 1000:
            yield out()
            done.clear()
    if of is not None:
        done.append((of, best, count, last))
    if done:
        yield out()


def best_skill(patterns: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, best_skill) for queries(qid, query) of a known pattern."""
    return queries.select("qid", pattern_key(F.col("query")).alias("pattern_key")).join(patterns.select("pattern_key", "best_skill"), "pattern_key").select("qid", "best_skill")
