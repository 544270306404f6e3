"""The engine's API: a catalogue and append-only logs in a folder, and the tools that work on them.

Tables are Parquet below `root`: session_events, session_skills, feedback, usage_events and recipes are append-only logs (of
recipes with one name the last counts); the catalogue, `skills`, stands in segments with its postings and vectors, so that a load writes no more
than what it brings and queries tokenise nothing but themselves. Nothing is changed or renamed once written: a writer that dies
leaves files that nobody reads, and every engine on a folder sees what others have finished. Numbers of rows are given out by one
writer at a time."""

from __future__ import annotations

import datetime
import functools
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas
from quern.operators import dense, entities, fusion, graph, learning, lexical, optimize, select, sessions, usage
from quern.operators.segments import Segments
from quern.runtime import numbered, written
from quern.sources import catalogue, documents, frontmatter

log = logging.getLogger(__name__)
SCHEMAS = {
    "session_events": schemas.SESSION_EVENTS, "session_skills": schemas.SESSION_LOG, "feedback": schemas.FEEDBACK_LOG,
    "usage_events": schemas.USAGE_LOG, "recipes": f"id bigint, {schemas.RECIPES}",
}


#: How an agent is told to work with the tools.
GUIDE = """\
# Finding the right document

1. Ask first: `query` with the task at hand; take the best two or three, not the whole catalogue.
2. Open a session with `session_start` when a conversation begins, and note what is used with `session_use`.
3. `session_context` gives a short block of what was used last.
4. Tell `feedback` whether a document helped; later rankings learn from it.
5. `session_end` closes the session.

Only what is asked for is loaded, so most of the catalogue's tokens are saved.
"""


def safe(tool: Callable) -> Callable:
    """A tool that returns {"error": message, "type": name} instead of raising."""

    @functools.wraps(tool)
    def call(*args, **kwargs):
        try:
            return tool(*args, **kwargs)
        except Exception as e:  # whatever goes wrong is told to the caller
            return {"error": str(e), "type": type(e).__name__}

    return call


class Engine:
    """`embed` makes vectors of texts; `category_root` is the folder whose subfolders name categories."""

    def __init__(self, spark: SparkSession, root: str, embed: dense.Embedder = dense.hashed, category_root: str = ""):
        self.spark, self.root, self.embed, self.category_root = spark, root.rstrip("/"), embed, category_root
        self.skills = Segments(spark, f"{self.root}/skills", embed=embed)

    # tables
    def table(self, name: str) -> DataFrame:
        if name == "skills":
            return self.skills.catalogue()
        path = f"{self.root}/{name}"
        log = self.spark.read.schema(SCHEMAS[name]).parquet(path) if documents._exists(self.spark, path) else self.spark.createDataFrame([], SCHEMAS[name])
        return catalogue.newest_recipes(log) if name == "recipes" else log

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def _row(self, name: str, *values) -> None:
        self.append(name, self.spark.createDataFrame([values], SCHEMAS[name]))

    # catalogue
    def index(self, folder: str, roots: list[str] | None = None, recursive: bool = True, exclude: list[str] = (), dedup: bool = False) -> int:
        """Scan, parse and merge documents; returns how many were read."""
        if roots is not None:
            documents.guarded(folder, roots, self.spark)
        found = documents.parse(documents.scan(self.spark, folder, recursive, exclude), self.category_root)
        old = self.table("skills")
        last = old.agg(F.coalesce(F.max("rowid"), F.lit(0))).first()[0]
        # rows are numbered in the order of their paths; old rows of the same names give their numbers and tags
        seq = numbered(found.select("path"), "path", "seq")
        same = old.join(found.select("name").distinct(), "name", "left_semi")
        loads = same.withColumnRenamed("rowid", "load_seq").unionByName(found.join(seq, "path").withColumn("load_seq", (F.col("seq") + last).cast("bigint")).drop("seq"))
        new, n = written(catalogue.upsert(loads).select(old.columns), "loads"), found.count()
        if n:
            self.skills.add(new)
            self.skills.merge()
        if dedup:
            self.dedup()
        return n

    def index_existing(self, folders: list[str], **options) -> dict[str, int]:
        """Index those of some candidate folders that are there; documents read by folder."""
        return {f: self.index(f, **options) for f in documents.existing(self.spark, folders)}

    def corrupt(self, folder: str) -> DataFrame:
        """(path, error) of files that index() leaves out."""
        return documents.corrupt(self.spark, folder)

    def dedup(self) -> tuple[DataFrame, DataFrame]:
        """Remove merged rows: one row (total, removed), and the groups (survivor, kept, removed)."""
        before = self.table("skills")
        groups = written(entities.groups(before.select("rowid", "name")), "groups")
        n = before.count()
        removed = groups.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0]
        if removed:
            gone = groups.select(F.explode("removed").alias("name")).join(before, "name").select("rowid")
            self.skills.add(before.limit(0), gone)
        return self.spark.createDataFrame([(n, removed)], "total long, removed long"), groups

    def list(self, category: str | None = None) -> DataFrame:
        """The catalogue, the most used names first."""
        return catalogue.by_use(self.table("skills"), self.table("usage_events").select("skill_name").unionByName(self.table("session_skills").select("skill_name")), category)

    def shown(self, results: DataFrame) -> DataFrame:
        """(qid, rank, line): results of query() as text."""
        return catalogue.as_text(results.join(self.table("skills").select("name", "description", "tags", "token_cost_meta", "token_cost_body"), "name"))

    def stats(self) -> DataFrame:
        return self.table("skills").groupBy("category").agg(F.count("*").alias("cnt"), F.sum("token_cost_meta").alias("meta_tokens"), F.sum("token_cost_body").alias("body_tokens"))

    def optimize(self) -> DataFrame:
        """What rewriting the catalogue's metadata would change."""
        return optimize.optimized(self.table("skills"))

    def optimize_folder(self, folder: str, apply: bool = False) -> DataFrame:
        """What rewriting changes in each document of a folder, with an error where one can't be read or written.

        Without `apply` files stay as they are."""
        files = documents.scan(self.spark, folder)
        docs = documents.parse(files, self.category_root)
        docs = docs.join(numbered(docs.select("path"), "path", "rowid"), "path")
        result = optimize.optimized(docs).join(docs.select("rowid", "path"), "rowid")
        result = written(result, "optimized") if apply else result  # files change below it
        errors = documents.corrupt(self.spark, folder)
        if apply:
            new = documents.rewritten(files.join(result.where("changed").select("path", "name", "description", "tags"), "path"))
            errors = errors.unionByName(documents.applied(self.spark, new, folder))
        return result.join(errors, "path", "full").withColumn("changed", F.coalesce("changed", F.lit(False)))

    # retrieval
    def query(self, queries: DataFrame, top_k: int = 5, method: str = "rrf", threshold: float = 0.0, session: str | None = None, boost_graph: bool = False, use_feedback: bool = False, budget: int | None = None, log_at: datetime.datetime | None = None) -> DataFrame:
        """(qid, rank, name, score, method) for queries(qid, query); by words, vectors or both fused; three independent re-scorings; a token
        budget in place of top_k."""
        docs, wide = self.table("skills"), 30 if budget else top_k * 4
        deep, columns = wide * 3 if method == "rrf" else wide, ["qid", "rank", "name", "score", "method"]
        if method not in ("rrf", "bm25", "embed"):
            raise ValueError(f"method {method}: one of rrf, bm25, embed")
        lists = []
        if method != "embed":
            lists.append(lexical.search(queries, docs, deep, index=self.skills.index()).select(columns))
        if method != "bm25":
            try:  # written here, so that an embedder that fails does so now
                lists.append(written(dense.search(queries, docs, deep, self.embed, self.skills.vectors()).select(columns), "similar"))
            except Exception as e:  # whatever goes wrong with a model, words still find something
                log.info("vectors failed, searching by words: %s", e)
                if not lists:
                    lists.append(lexical.search(queries, docs, deep, index=self.skills.index()).select(columns))
                if method == "rrf":
                    method = "bm25"
        found = fusion.rrf(lists, queries, docs, wide) if method == "rrf" else lists[0].where(F.col("rank") <= wide)
        if session:
            recent = sessions.recent_skills(self.table("session_skills").where(F.col("session_id") == session)).select(F.col("skill_name").alias("name"))
            found = fusion.session_boost(found, recent)
            if boost_graph:
                found = fusion.graph_boost(found, graph.pagerank(self.edges(), recent))
        if use_feedback:
            found = fusion.feedback_weighted(found, learning.skill_weights(self.table("feedback")))
        found = select.threshold(found, threshold)
        if budget:
            return select.budgeted(found.join(docs.select("name", F.col("token_cost_body").alias("tokens"), "body"), "name"), budget)
        found = found.where(F.col("rank") <= top_k)
        if log_at:
            rows = found.join(queries, "qid").select((F.lit(int(log_at.timestamp() * 1e6)) + F.col("qid") * 1000 + F.col("rank")).cast("bigint").alias("id"), F.lit(log_at).cast("timestamp_ntz").alias("timestamp"), F.col("name").alias("skill_name"), "query", F.col("method").alias("retrieval_method"), "score", F.lit(0).cast("bigint").alias("tokens_saved"), F.lit(0).cast("bigint").alias("latency_ms"))
            self.append("usage_events", usage.valid_events(rows))
        return found

    def query_adaptive(self, queries: DataFrame, least: int = 1, most: int = 10, ratio: float = 2.0) -> DataFrame:
        """As many results as the scores' elbow allows, two of a category."""
        found = select.adaptive(self.query(queries, most * 4), least, most, ratio)
        return select.diverse(found.join(self.table("skills").select("name", "category"), "name"), most)

    # sessions
    def session_start(self, session: str, at: datetime.datetime, metadata: str = "{}") -> None:
        self._row("session_events", session, "start", at, metadata)

    def session_end(self, session: str, at: datetime.datetime) -> None:
        self._row("session_events", session, "end", at, None)

    def session_use(self, session: str, name: str, at: datetime.datetime, query: str = "", success: bool | None = None) -> None:
        row = self.spark.createDataFrame([(int(at.timestamp() * 1e6), session, name, query, at, success)], SCHEMAS["session_skills"])
        self.append("session_skills", sessions.valid_uses(row))

    def session_context(self, session: str | None = None, n: int = 5) -> DataFrame:
        who = sessions.resolve_session(sessions.session_headers(self.table("session_events")), session)
        return sessions.context_block(sessions.recent_skills(self.table("session_skills").join(who, "session_id"), n))

    # learning and reports
    def feedback(self, query: str, name: str, success: bool, at: datetime.datetime, latency_ms: int = 0, rating: int | None = None) -> None:
        self._row("feedback", int(at.timestamp() * 1e6), query, name, success, latency_ms, rating, at)

    def feedback_stats(self) -> tuple[DataFrame, DataFrame]:
        log = self.table("feedback")
        return learning.feedback_stats(log), learning.top_rates(learning.skill_weights(log))

    def insights(self, as_of: datetime.datetime, days: int = 30) -> dict[str, DataFrame]:
        return usage.insights(self.table("usage_events"), self.table("skills"), as_of, days)

    def edges(self) -> DataFrame:
        """The similarity graph, all five builders in order."""
        docs = self.table("skills")
        pairs = graph.cooccurrence_edges(self.table("session_skills")).unionByName(graph.content_edges(docs)).unionByName(graph.feedback_edges(learning.skill_weights(self.table("feedback")))).unionByName(graph.text_edges(docs))
        return graph.both_ways(pairs.unionByName(graph.path_edges(docs, pairs)))

    def neighbors(self, name: str, edge_types: list[str] | None = None) -> DataFrame:
        return graph.neighbors(self.edges(), name, edge_types)

    def recipe(self, name: str, include_should: bool = True) -> DataFrame:
        return catalogue.recipe(self.table("recipes"), self.table("skills"), name, include_should)

    def recipe_save(self, name: str, must: list[str], should: list[str] = (), description: str = "") -> None:
        self._save_recipes([(name, description, list(must), list(should))])

    def _save_recipes(self, rows: list[tuple]) -> None:
        last = self.table("recipes").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self.append("recipes", self.spark.createDataFrame([(last + 1, *r) for r in rows], SCHEMAS["recipes"]))

    def recipes_load(self, text: str) -> int:
        """Take the recipes of a YAML file in, in place of their namesakes; returns how many."""
        new = frontmatter.recipes(text)
        if new:
            self._save_recipes(new)
        return len(new)

    def guide(self) -> str:
        """How an agent works with the tools."""
        return GUIDE

    def tools(self) -> dict[str, Callable]:
        """The tools by name, none of which raises."""
        names = """query index dedup list stats session_start session_use session_context session_end optimize optimize_folder feedback
        feedback_stats query_adaptive insights neighbors recipe recipe_save guide""".split()
        return {x: safe(getattr(self, x)) for x in names}
