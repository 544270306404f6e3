"""Numeric goldens, edge cases and invariants of the engine's operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.unicode import jaro, jaro_winkler_score
from quern.operators import entities, fusion, graph, learning, lexical, select, sessions, usage
from quern.operators.components import components

DOCS = [
    ("cluster-deploy", "Deploy services to kubernetes", ["kubernetes", "deploy"], "Roll out with kubectl"),
    ("unit-tests", "Run the unit tests", ["pytest"], "Run pytest and fix failures"),
    ("db-backup", "Backup a database", ["sql"], "Dump with pg_dump nightly"),
    ("docker-build", "Build container images", ["docker"], "docker build and push the image"),
    ("monitoring", "Watch service metrics", ["metrics"], "Alert on errors"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, d, b, "ops", t, i) for i, (n, d, t, b) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "name string, description string, body string, category string, tags array<string>, rowid bigint")


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid int, query string")


def ranked(spark, scores):
    return spark.createDataFrame([(1, i + 1, f"n{i}", float(s)) for i, s in enumerate(scores)], "qid int, rank int, name string, score double")


@pytest.mark.parametrize(
    ("scores", "options", "k"),
    [
        ([1.20, 1.18, 1.05, 1.04, 1.04, 1.03], {}, 2), ([0.5] * 4, {}, 0), ([1.04, 1.03, 1.02, 1.01, 1.00, 0.99], {"most": 6}, 6), ([1.2], {}, 1), ([1.2, 1.0], {"ratio": 0.9}, 1),
        ([1.15, 1.14, 1.05, 1.04, 1.03], {"ratio": 2.0}, 2), ([1.20, 1.18, 1.05, 1.04], {"ratio": 100}, 4), ([1.2, 1.2, 1.0, 0.99], {}, 2),
    ],
)
def test_elbow(spark, scores, options, k):
    assert select.elbow(ranked(spark, scores), **options).first().k == k


def test_elbow_of_nothing(spark):
    assert select.elbow(ranked(spark, [1.0]).limit(0)).count() == 0


def test_search_ranks(spark, docs):
    top = {r.qid: r.name for r in lexical.search(ask(spark, "kubernetes deploy", "docker", "zzznothing", "", "pg_dump"), docs).where("rank = 1").collect()}
    assert top == {0: "cluster-deploy", 1: "docker-build", 4: "db-backup"}


def test_search_limits(spark, docs):
    assert lexical.search(ask(spark, "build image database service"), docs, top_k=2).count() <= 2
    assert lexical.search(ask(spark, "docker"), docs, threshold=2.0).count() == 0


def test_budget(spark):
    rows = spark.createDataFrame([(1, 1, 300), (1, 2, 100), (1, 3, 50), (2, 1, 900), (2, 2, 800)], "qid int, rank int, tokens int")
    assert sorted((r.qid, r["rank"]) for r in select.budgeted(rows, 350).collect()) == [(1, 1), (2, 1)]
    assert sorted((r.qid, r["rank"]) for r in select.budgeted(rows, 400).collect()) == [(1, 1), (1, 2), (2, 2)]


def test_diverse(spark):
    rows = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate(["a", "a", "a", None, "", "b"])], "qid int, rank int, category string")
    assert [r["rank"] for r in select.diverse(rows, 4).orderBy("rank").collect()] == [1, 2, 4, 5]
    assert select.diverse(rows, 1).count() == 6


def test_session_boost(spark):
    out = fusion.session_boost(ranked(spark, [1.0, 0.8]).withColumn("method", F.lit("bm25")), spark.createDataFrame([("n1",)], "name string"))
    first = out.where("rank = 1").first()
    assert (first.name, first.score, first.method) == ("n1", 1.3, "bm25+session")


def test_feedback(spark):
    log = [(1, "a thing", "x", True), (2, "a thing", "x", True), (3, "b", "y", False), (4, "a thing", "y", True), (5, "a thing", "z", True), (6, "other", "q", False)]
    df = spark.createDataFrame([(*r, datetime.datetime(2024, 1, r[0])) for r in log], "id int, query string, skill_name string, success boolean, timestamp timestamp_ntz")
    weights = {r.skill_name: r.base_weight for r in learning.skill_weights(df).collect()}
    assert weights["x"] == 0.75 and weights["q"] == pytest.approx(1 / 3)
    patterns = {r.pattern_key: (r.best_skill, r["count"]) for r in learning.query_patterns(df).collect()}
    assert patterns == {"thing": ("x", 4), "other": ("q", 1)}


def test_pattern_switch(spark):
    log = [(1, "deploy it", "bad", False), (2, "deploy it", "good", True)]
    df = spark.createDataFrame([(*r, datetime.datetime(2024, 1, r[0])) for r in log], "id int, query string, skill_name string, success boolean, timestamp timestamp_ntz")
    assert learning.query_patterns(df).first().best_skill == "good"


def test_query_patterns_against_a_loop(spark):
    from conftest import SMALL

    from quern.sources.adapters import event_feedback

    log = event_feedback(spark, SMALL).withColumn("k", text.pattern_key(F.col("query"))).orderBy("id").collect()
    stats, best = {}, {}
    for r in log:
        s, n = stats.get(r.skill_name, (0, 0))
        stats[r.skill_name] = (s + r.success, n + 1)
        rate = lambda x: stats[x][0] / stats[x][1]  # noqa: B023, E731
        b, c = best.get(r.k, (r.skill_name, 0))
        if r.success and r.skill_name != b and rate(r.skill_name) > rate(b):
            b = r.skill_name
        best[r.k] = (b, c + 1)
    got = {r.pattern_key: (r.best_skill, r["count"]) for r in learning.query_patterns(event_feedback(spark, SMALL)).collect()}
    assert got == best


def test_sessions(spark):
    rows = [(i, "s", f"k{i % 4}", datetime.datetime(2024, 1, 1, 0, i), None) for i in range(10)] + [(11, "s", " ", datetime.datetime(2024, 1, 2), True), (12, None, "k", datetime.datetime(2024, 1, 2), True)]
    uses = sessions.valid_uses(spark.createDataFrame(rows, "id int, session_id string, skill_name string, timestamp timestamp_ntz, success boolean").withColumn("query", F.lit("")))
    assert [r.skill_name for r in sessions.recent_skills(uses, 3).orderBy("place").collect()] == ["k1", "k0", "k3"]
    assert sessions.load_session(uses).first().uses[0].success is None


def test_usage(spark):
    day = datetime.datetime(2024, 1, 5)
    rows = [(i, day, "a", "m", None if i else 800, 10 * i) for i in range(1, 6)]
    log = spark.createDataFrame(rows, "id int, timestamp timestamp_ntz, skill_name string, retrieval_method string, tokens_saved bigint, latency_ms bigint")
    assert usage.daily_stats(log).first().avg_latency_ms == 30
    assert usage.tokens_saved(log.limit(0)).first().tokens_saved == 0
    names = spark.createDataFrame([("a", 1), ("b", 2)], "name string, rowid int")
    assert [r.name for r in usage.unused(names, log).collect()] == ["b"]
    assert usage.unused(names, log.unionByName(log.limit(1).withColumn("skill_name", F.lit(None).cast("string")))).count() == 0


def test_jaro():
    assert 0.7 <= jaro("CRATE", "TRACE") <= 0.8
    assert jaro("", "") == 1 and jaro("a", "") == 0
    assert jaro_winkler_score("deploy cluster", "deploy clusters") > 0.92


def test_entropy_and_shingles(spark):
    r = spark.range(1).select(text.entropy(F.lit("utils")).alias("a"), text.entropy(F.lit("kubernetes-deployment-pipeline")).alias("b"), text.name_shingles(F.lit("ab")).alias("c"), text.name_shingles(F.lit("")).alias("d"), text.entropy(F.lit(None).cast("string")).alias("e")).first()
    assert r.a < 2.5 and r.b > 3.0 and r.c == ["ab"] and r.d == [] and r.e == 0


def test_entities(spark):
    names = ["Data Pipeline Builder", "data-pipeline_builder", "data pipeline bulider", "web scraper toolkit", "model-v1", "model-v2", "", None]
    df = spark.createDataFrame(list(enumerate(names)), "rowid bigint, name string")
    keep = {r.rowid: r.survivor for r in entities.survivors(df).collect()}
    assert keep[1] == 0 and keep[3] == 3 and keep[4] == 4 and keep[5] == 5 and keep[7] == 6


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(edges).collect()}
    assert set(found.values()) == {1, 100} and found[40] == 1 and len(found) == 42
    assert components(edges.limit(0)).count() == 0


def test_graph(spark):
    d = spark.createDataFrame([("a", "x", "ops", ["p", "q", "r"]), ("b", "y", "ops", ["p", "q", "s"]), ("c", "z", "dev", ["t"]), ("d", "w", "uncategorized", [])], "name string, description string, category string, tags array<string>")
    edges = graph.content_edges(d).collect()
    assert [(e.src, e.dst, e.weight) for e in edges] == [("a", "b", 0.5)]
    both = graph.both_ways(graph.content_edges(d))
    seeds = spark.createDataFrame([("a",), ("nowhere",)], "name string")
    assert graph.pagerank(both, seeds).agg(F.sum("score")).first()[0] == pytest.approx(1 - 0.85**20)
    assert graph.pagerank(both.limit(0), seeds).count() == 0
    assert graph.pagerank(both, seeds.limit(0)).count() == 0


def test_release(spark):
    from quern import runtime

    kept = runtime.written(spark.range(5), "five")
    path = kept.inputFiles()[0].rpartition("/")[0]
    assert kept.count() == 5 and runtime.release(spark) >= 1
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@pytest.mark.parametrize("block", [1000, 3])
def test_path_edges_against_a_loop(spark, monkeypatch, block):
    """Names of one and of several paths, other edges, and folders larger than a block: every pair once, whatever the blocks."""
    monkeypatch.setattr(graph, "FOLDER_BLOCK", block)
    paths = [(f"n{k:02}", f"/h{k % 2}/d{k % 3}/f{k}") for k in range(24)] + [("n01", "/h0/d9/x"), ("n01", "/h1/d1/again"), ("n01", "/h1/d1/f1"), ("n05", "/h0/d9/y"), ("z", "z"), ("e", ""), ("o", None)]
    others = [("n02", "n08", 0.5, "co_occur"), ("n10", "n04", 0.3, "text_overlap"), ("n03", "n01", 0.9, "content"), ("n00", "n02", 0.1, "feedback"), ("n00", "nowhere", 0.9, "co_occur")]
    strong = {tuple(sorted(x[:2])) for x in others if x[3] in ("co_occur", "text_overlap") and x[2] >= graph.PARENT}
    cut = lambda p: p.rpartition("/")[0] if "/" in p else p
    places = [(n, cut(p), cut(cut(p))) for n, p in paths if p]
    share = lambda k: {(a[0], b[0]) for a in places for b in places if a[0] < b[0] and a[k] == b[k] != ""}
    near = share(1) - strong
    far = share(2) - near - {tuple(sorted(x[:2])) for x in others}
    got = graph.path_edges(spark.createDataFrame(paths, "name string, path string"), spark.createDataFrame(others, "src string, dst string, weight double, edge_type string"))
    want = sorted([(*p, graph.PARENT) for p in near] + [(*p, graph.GRANDPARENT) for p in far])
    assert sorted((r.src, r.dst, r.weight) for r in got.collect()) == want


def test_path_edges_of_a_large_folder_are_dealt(spark, monkeypatch):
    """One folder of 3000 names: no task makes more than a fraction of its pairs."""
    monkeypatch.setattr(graph, "FOLDER_BLOCK", 100)
    paths = spark.range(3000).select(F.format_string("n%05d", "id").alias("name"), F.concat(F.lit("/one/d/"), "id").alias("path"))
    got = graph.path_edges(paths, spark.createDataFrame([], "src string, dst string, weight double, edge_type string"))
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 3000 * 2999 // 2 and max(tasks) < sum(tasks) / 4
