"""Trained text vectors against numpy on the whole matrix, and against hashed counts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quern.operators import dense, latent
from quern.plans.engine import Engine
from quern.sources import adapters


def matrix(spark, texts):
    """The matrix as numpy has it, from rows(); its rows in order of id."""
    counts = latent.counted(texts)
    found = latent.rows(latent.weighted(counts, latent.inverse_frequencies(counts))).orderBy("id").collect()
    x = np.zeros((len(found), latent.FEATURES))
    for k, r in enumerate(found):
        x[k, r.features] = r.weights
    return [r.id for r in found], x


@pytest.fixture(scope="module")
def bodies(spark):
    return adapters.documents(spark, SMALL).select(F.col("rowid").alias("id"), F.col("body").alias("text"))


def test_rows_by_hand(spark):
    import hashlib

    texts = ["a b b c", "b c d", "Ä ä", ""]
    ids, x = matrix(spark, spark.createDataFrame([*enumerate(texts), (9, None)], "id long, text string"))
    feature = lambda t: int(hashlib.sha1(t.encode()).hexdigest()[:4], 16)
    docs = [Counter(re.findall(r"\w", t.lower().replace("ä", "a"))) for t in texts]
    held = Counter(t for d in docs for t in d)
    want = np.zeros((3, latent.FEATURES))
    for k, d in enumerate(docs[:3]):
        for t, n in d.items():
            want[k, feature(t)] = (1 + math.log(n)) * (math.log(4 / (1 + held[t])) + 1)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert ids == [0, 1, 2] and np.allclose(x, want, atol=1e-12)


def test_singular_values_and_vectors_of_the_whole_matrix(spark, bodies):
    model = latent.fit(bodies, dimensions=8, spare=24, rounds=8)
    ids, x = matrix(spark, bodies)
    exact, right = np.linalg.svd(x, full_matrices=False)[1:]
    assert np.allclose(model.singular, exact[:8], rtol=1e-3)
    assert np.allclose(model.v.T @ model.v, np.eye(8), atol=1e-9)
    # the space of the leading vector, which stands apart from the others
    assert abs(right[0] @ model.v[:, 0]) > 0.999
    folded = {r.id: r.embedding for r in model(bodies).collect()}
    assert sorted(folded) == ids and np.allclose([folded[k] for k in ids], x @ model.v, atol=1e-9)


def test_any_partitioning_and_long_rows(spark, bodies, monkeypatch):
    one = latent.fit(bodies.coalesce(1), dimensions=8, rounds=1)
    monkeypatch.setattr(latent, "HELD", 50)  # here a row is longer; tasks have their own value
    many = latent.fit(bodies.repartition(9), dimensions=8, rounds=1)
    assert np.allclose(one.singular, many.singular, atol=1e-9)
    w, f = np.arange(1.0, 8.0), np.array([3, 5, 9, 3, 4, 5, 9])
    import pyarrow as pa

    some = list(latent._parts(pa.array([f[:3], f[3:]]), pa.array([w[:3], w[3:]])))
    assert [x.tolist() for x, _, _ in some] == [f.tolist()] and some[0][2].tolist() == [0, 3]
    monkeypatch.setattr(latent, "HELD", 2)
    some = list(latent._parts(pa.array([f[:3], f[3:]]), pa.array([w[:3], w[3:]])))
    assert [x.tolist() for x, _, _ in some] == [f[:3].tolist(), f[3:].tolist()]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "id long, text string")
    model = latent.fit(empty, dimensions=4)
    assert model.singular.tolist() == [0] * 4 and model(empty).count() == 0
    few = spark.createDataFrame([(1, "red fox"), (2, None), (3, "..."), (4, "red fox")], "id long, text string")
    model = latent.fit(few, dimensions=4)
    assert np.allclose(model.singular, [math.sqrt(2), 0, 0, 0], atol=1e-6)
    assert sorted(r.id for r in model(few).collect()) == [1, 4]
    assert model(spark.createDataFrame([(1, "unheard")], "id long, text string")).count() == 0


def test_saved_models_and_the_engine(spark, bodies, tmp_path):
    model = latent.fit(bodies, dimensions=8, rounds=1)
    model.save(f"file://{tmp_path}/model")
    again = latent.load(spark, f"file://{tmp_path}/model")
    assert np.array_equal(model.v, again.v) and np.array_equal(model.idf, again.idf)
    for k, text in enumerate(["a lion and a zebra in the grass", "a tiger and a zebra", "valves and pistons of engines", "pistons of a pump"]):
        (tmp_path / "docs" / f"d{k}").mkdir(parents=True)
        (tmp_path / "docs" / f"d{k}" / "SKILL.md").write_text(f"---\nname: d{k}\ndescription: {text}\n---\n{text}\n")
    plain = Engine(spark, f"file://{tmp_path}/store")
    plain.index(f"file://{tmp_path}/docs")
    trained = latent.fit(dense.described(plain.table("skills")), dimensions=2)
    e = Engine(spark, f"file://{tmp_path}/other", embed=trained)
    e.index(f"file://{tmp_path}/docs")
    found = e.query(spark.createDataFrame([(1, "pistons")], "qid int, query string"), 2, "embed").orderBy("rank").collect()
    assert {r.name for r in found} == {"d2", "d3"}


def test_halves_of_texts_find_each_other_better_than_by_hashed_counts(spark, bodies):
    words = F.split("text", " ")
    half = lambda k: F.array_join(F.filter(words, lambda _, i: i % 2 == k), " ")
    first, second = (bodies.where("size(split(text, ' ')) >= 20").select("id", half(k).alias("text")) for k in (0, 1))
    model = latent.fit(bodies)
    recall = []
    for embed in (model, dense.hashed):
        found = dense.cosine_topk(embed(first).withColumnRenamed("id", "qid"), embed(second), 10)
        recall.append(found.where("qid = id").count() / first.count())
    assert recall[0] > recall[1], recall


def test_texts_are_counted_where_they_lie(spark):
    """No shuffle of tokens, and features in order, whatever the partitions."""
    texts = spark.createDataFrame([(k, "b a b " * (k % 3) + f"w{k} É") for k in range(40)] + [(99, ""), (100, None)], "id long, text string").repartition(7).cache()
    texts.count()
    plan = latent.packed(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0]
    found = {r.id: dict(zip(r.features, r.counts, strict=True)) for r in latent.packed(texts).collect()}
    assert len(found) == 40 and all(list(x) == sorted(x) for x in found.values())
    assert {(i, f, int(n)) for i, x in found.items() for f, n in x.items()} == {tuple(r) for r in latent.counted(texts).collect()}
    assert sum(found[2].values()) == 8 and max(found[2].values()) == 4


def test_nearest_rows_by_products_are_those_of_every_pair(spark):
    """Ties of copies, zeros, nulls, other lengths and values that aren't finite; few pairs reach the exact scores."""
    made = np.random.default_rng(3).integers(-3, 4, (1500, 6)).astype(float).tolist()
    odd = [[0.0] * 6, None, [1.0], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1e300] * 6]
    v = spark.createDataFrame([*enumerate(made + odd)], "id long, embedding array<double>")
    for ids in ([0, 1, 2, 3], [5, 1500, 1501, 1502, 1503, 1504, 1505, 1506]):
        q = v.where(F.col("id").isin(ids)).withColumnRenamed("id", "qid")
        pairs = v.select("id", F.col("embedding").alias("v")).crossJoin(F.broadcast(q.select("qid", F.col("embedding").alias("q"))))
        norm = lambda x: F.sqrt(dense.dot(F.col(x), F.col(x)))
        pairs = pairs.select("qid", "id", (dense.dot(F.col("q"), F.col("v")) / (norm("q") * norm("v") + 1e-10)).alias("score"))
        want = pairs.withColumn("rank", F.expr("row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)")).where("rank <= 10").select("qid", "rank", "id", "score")
        assert sorted(map(str, dense.cosine_topk(q, v, 10).collect())) == sorted(map(str, want.collect()))
    import pyarrow as pa

    sent = type("Sent", (), {"value": (np.array(made[:20]), np.zeros(20, bool))})
    batch = pa.record_batch([pa.array(range(1500)), pa.array(made, pa.list_(pa.float64()))], names=["id", "v"])
    assert 200 <= sum(len(b) for b in dense._near(sent, 10)([batch])) < 20 * 1500 / 4
