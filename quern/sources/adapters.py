"""Logical tables of the engine out of the driver's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import index_tokens, token_estimate
from quern.runtime import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of `documents`."""
    return catalogued(table(spark, sf_dir, "documents"))


def catalogued(d: DataFrame) -> DataFrame:
    """A catalogue of (doc_id, text, lang, source): first line as description, source as category, language as tag."""
    name, line = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.split_part("text", F.lit("\n"), F.lit(1))
    return d.select(
        name.alias("name"), line.alias("description"), F.col("text").alias("body"), F.concat(F.lit("/"), "source", F.lit("/"), name).alias("path"), F.col("source").alias("category"),
        F.array("lang").alias("tags"), token_estimate(F.concat_ws(" ", name, line)).alias("token_cost_meta"), token_estimate(F.col("text")).alias("token_cost_body"), F.col("doc_id").alias("rowid"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of distinct part names."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("rowid"), F.min("p_type").alias("category"), F.min("p_brand").alias("brand"))
    return p.select(F.col("p_name").alias("name"), F.concat_ws(" ", "category", "brand").alias("description"), F.col("p_name").alias("body"), "category", F.split("p_name", " ").alias("tags"), "rowid")


def part_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of part names: an order's lines."""
    lines, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(p, lines.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("session_id"), F.col("p_name").alias("skill_name"))


def word_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of words: a benchmark item's."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("session_id"), F.explode(index_tokens(F.col("text"))).alias("skill_name"))


def part_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback on part names, for aggregates that don't depend on order."""
    lines, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(p, lines.l_partkey == p.p_partkey).select(F.col("p_name").alias("skill_name"), (F.col("l_returnflag") != "R").alias("success"), F.col("l_shipdate").alias("timestamp"), F.col("l_linestatus").alias("query"))


def event_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session log: users' events."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("skill_name"), F.col("ts").alias("timestamp"), F.lit("").alias("query"), (F.col("value") > 30).alias("success"))


def event_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A usage log of the `events` table."""
    return usage_log(table(spark, sf_dir, "events"))


def usage_log(events: DataFrame) -> DataFrame:
    """A usage log: events with their key as tokens saved and the user's last digit as method."""
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("skill_name"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("retrieval_method"),
        F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens_saved"), (F.col("event_id") % 50).alias("latency_ms"),
    )


#: Fixed task phrases for the order-dependent feedback log.
PHRASES = ["deploy the cluster", "run unit tests", "backup a database", "build an image", "monitor the service", "please help me deploy cluster", "search logs for errors"]


def event_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feedback log in order of event_id."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("user_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), phrase.alias("query"), F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("skill_name"), (F.col("value") > 30).alias("success"), F.col("ts").alias("timestamp"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages: host/lang/id."""
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
