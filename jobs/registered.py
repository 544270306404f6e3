"""The jobs as queries: each runs twice over the whole tables into one new folder, and returns its output read back; and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import index_documents, usage_report
from quern.plans.oracles import DOCS, index_tokens
from quern.runtime import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; it stays."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "job1")
    for _ in range(2):
        usage_report.run(spark, f"{sf_dir.rstrip('/')}/events.parquet", out)
    return usage_report.output(spark, out)


def job2_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "job2")
    documents = f"{sf_dir.rstrip('/')}/documents.parquet*"  # a file or a folder; a file stream takes a single file as a pattern only
    for _ in range(2):
        index_documents.run(spark, documents, f"{out}/index", f"{out}/checkpoint")
    return index_documents.output(spark, f"{out}/index")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_usage_report": job1_usage_report, "job2_index_documents": job2_index_documents}
USAGE_SQL = """
WITH u AS (SELECT CAST(ts AS DATE) AS date, event_type AS skill_name, 'm' || (user_id % 3) AS retrieval_method, CAST(json_extract_string(props, '$.k') AS BIGINT) AS saved, event_id % 50 AS ms
 FROM events WHERE ts IS NOT NULL AND trim(event_type) <> ''),
s AS (SELECT date, skill_name, retrieval_method, count(*) AS queries, CAST(coalesce(sum(saved), 0) AS BIGINT) AS tokens_saved, round(avg(ms), 6) AS latency_ms FROM u GROUP BY ALL),
n AS (SELECT date, skill_name, sum(queries) AS q FROM s GROUP BY ALL),
d AS (SELECT date, count(*) AS day_queries, count(DISTINCT skill_name) AS day_skills, CAST(coalesce(sum(saved), 0) AS BIGINT) AS day_tokens, round(avg(ms), 6) AS day_latency FROM u GROUP BY date),
r AS (SELECT date, skill_name, CAST(dense_rank() OVER (PARTITION BY date ORDER BY q DESC, skill_name) AS INT) AS place FROM n)
SELECT s.date, s.skill_name, s.retrieval_method, s.queries, s.tokens_saved, s.latency_ms, round(s.queries / d.day_queries, 6) AS share, r.place,
 d.day_queries, d.day_skills, d.day_tokens, d.day_latency, d.day_queries - coalesce(y.day_queries, 0) AS day_change
FROM s JOIN d ON d.date = s.date JOIN r ON r.date = s.date AND r.skill_name = s.skill_name LEFT JOIN d y ON y.date + 1 = s.date
"""
_COLUMNS = [("name", "name"), ("description", "description"), ("body", "body"), ("tags", "tags_json")]
INDEX_SQL = f"""
WITH {DOCS}, lists AS ({" UNION ALL ".join(f"SELECT rowid, '{c}' AS col, {index_tokens(x)} AS t FROM docs" for c, x in _COLUMNS)}),
lens AS (SELECT rowid, CAST(sum(len(t)) AS BIGINT) AS length FROM lists GROUP BY rowid),
toks AS (SELECT rowid, col, unnest(t) AS term, unnest(range(len(t))) AS pos FROM lists),
c AS (SELECT rowid, col, term, count(*) AS n, min(pos) AS first_pos FROM toks GROUP BY ALL)
SELECT c.rowid, c.col, c.term, c.n, c.first_pos, lens.length, docs.name, docs.category, (SELECT count(*) FROM docs) AS documents
FROM c JOIN lens ON lens.rowid = c.rowid JOIN docs ON docs.rowid = c.rowid
"""
ORACLE_SQL: dict[str, str] = {"job1_usage_report": USAGE_SQL, "job2_index_documents": INDEX_SQL}
