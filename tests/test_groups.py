"""Groups kept as groups, and residual push, against the graph of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import graph, groups


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        category = rng.choice(["ops", "data", "ops", None, "uncategorized", ""])
        path = rng.choice([f"/a/{i % 4}/n{i}", f"/b/{i % 3}/n{i}", f"/top/n{i}", None, f"n{i}"])
        rows.append((f"n{i:02}", f"text {i % 7} {rng.choice(['deploy', 'backup'])}", category, rng.choices(["x", "y", "z", "w"], k=rng.randint(0, 2)), path))
    docs = spark.createDataFrame(rows, "name string, description string, category string, tags array<string>, path string").cache()
    weights = spark.createDataFrame([(f"n{i:02}", i % 5, (i * 7) % 4) for i in range(40)], "skill_name string, successes long, failures long").cache()
    return docs, weights


def rows(frame):
    return sorted(map(str, frame.collect()))


def scores(frame):
    return {r.name: r.score for r in frame.collect()}


def both(docs, weights):
    pairs = graph.content_edges(docs).unionByName(graph.feedback_edges(weights)).unionByName(graph.text_edges(docs))
    return graph.both_ways(pairs), groups.united(groups.content(docs), groups.feedback(weights), groups.of_pairs(graph.text_edges(docs)))


def test_same_graph(made):
    docs, weights = made
    edges, g = both(docs, weights)
    edges = edges.cache()
    assert rows(groups.stats(g)) == rows(graph.graph_stats(edges))
    for name in ("n00", "n07", "n33", "nothing"):
        for kinds in (None, ["content"], ["feedback", "text_overlap"]):
            assert rows(groups.neighbors(g, name, kinds, 100)) == rows(graph.neighbors(edges, name, kinds, 100))
    assert g.members.count() <= docs.count() + weights.count()


def test_pagerank(spark, made):
    docs, weights = made
    edges, g = both(docs, weights)
    for names in (["n00", "n05", "nothing"], ["n01"], ["nothing"]):
        seeds = spark.createDataFrame([(n,) for n in names], "name string")
        want, got = scores(graph.pagerank(edges, seeds)), scores(groups.pagerank(g, seeds))
        assert want.keys() == got.keys() and all(got[n] == pytest.approx(want[n], abs=2e-5) for n in want)  # feedback weights aren't rounded


def test_folders(spark, made):
    paths = made[0].select("name", "path").unionByName(spark.createDataFrame([("p", "/only/p"), ("q", "/only/q"), ("r", "r")], "name string, path string"))
    edges = graph.both_ways(graph.path_edges(paths, spark.createDataFrame([], "src string, dst string, weight double, edge_type string")))
    g = groups.united(groups.folders(paths))
    assert rows(groups.stats(g)) == rows(graph.graph_stats(edges))
    assert rows(groups.neighbors(g, "p")) == rows(graph.neighbors(edges, "p")) and groups.neighbors(g, "p").count() == 1
    name = edges.orderBy("src").first().src
    assert rows(groups.neighbors(g, name, limit=100)) == rows(graph.neighbors(edges, name, limit=100))


def test_a_large_group_has_no_pairs(spark):
    """Ten thousand names of one category: fifty million pairs that no step makes."""
    docs = spark.range(10_000).select(F.format_string("n%05d", "id").alias("name"), F.lit("one").alias("category"), F.array(F.concat(F.lit("t"), "id")).alias("tags"))
    g = groups.united(groups.content(docs))
    assert {r.metric: r.value for r in groups.stats(g).collect()} == {"nodes": 10_000, "edges": 10_000 * 9_999 // 2, "type:content": 10_000 * 9_999}
    assert [r.weight for r in groups.neighbors(g, "n00000", limit=3).collect()] == [0.3] * 3
    found = scores(groups.pagerank(g, spark.createDataFrame([("n00003",)], "name string"), rounds=3))
    assert len(found) == 10_000 and sum(found.values()) == pytest.approx(1 - 0.85**3)


def test_residual_push(spark, made):
    docs, weights = made
    edges = both(docs, weights)[0].cache()
    sets = {1: ["n00", "n05", "nothing"], 2: ["n01"], 3: ["nothing"]}
    seeds = spark.createDataFrame([(s, n) for s, names in sets.items() for n in names], "set int, name string")
    got, report = groups.pushed(edges, seeds)
    for s, names in sets.items():
        want = scores(graph.pagerank(edges, spark.createDataFrame([(n,) for n in names], "name string"), tolerance=0))
        found = scores(got.where(F.col("set") == s))
        assert all(found.get(n, 0.0) == pytest.approx(x, abs=1e-7) for n, x in want.items()), s
    first = report.where("round = 1").first()
    own = edges.where("src in ('n00', 'n05')").select("src", "dst").distinct().count() + edges.where("src = 'n01'").select("dst").distinct().count()
    assert first.frontier == 3 and first.touched == own
    coarse, short = groups.pushed(edges, seeds, least=1e-3)
    assert sum(r.touched for r in short.collect()) < sum(r.touched for r in report.collect())
    close = {(r.set, r.name): r.score for r in coarse.collect()}
    assert all(abs(close.get((r.set, r.name), 0.0) - r.score) < 0.02 for r in got.collect())
