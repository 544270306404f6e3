"""Documents on disk, catalogue merges, rewriting, and the streaming forms."""

import pytest
from pyspark.sql import functions as F

from quern.sources import catalogue, documents
from quern.streaming import increments


@pytest.fixture
def tree(tmp_path):
    files = {
        "a/SKILL.md": "---\nname: alpha\ndescription: \"First: one\"\ncategory: ops\ntags: [x, 'y']\n---\n\nBody A\n",
        "b/SKILL.md": "No front-matter here",
        "c/SKILL.md": "---\nname: gamma\ntags:\n  - p\n  - q\n---\nBody C",
        "node_modules/n/SKILL.md": "skip", ".hidden/h/SKILL.md": "skip", "mine/m/SKILL.md": "skip",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/SKILL.md").write_bytes(b"\xff\xfe\x00")
    return tmp_path


def test_scan_and_parse(spark, tree):
    rows = {r.name: r for r in documents.parse(documents.scan(spark, f"file://{tree}", exclude=["mine"])).collect()}
    assert set(rows) == {"alpha", "b", "gamma"}
    assert rows["alpha"].description == "First: one" and rows["alpha"].tags == ["x", "y"] and rows["alpha"].category == "ops" and rows["alpha"].body == "Body A"
    assert rows["gamma"].tags == ["p", "q"] and rows["gamma"].category == "uncategorized" and rows["b"].body == "No front-matter here"
    assert documents.scan(spark, f"file://{tree}/missing").count() == 0
    assert documents.scan(spark, f"file://{tree}", recursive=False).count() == 0


def test_front_matter():
    """Escapes, comments, folded text, nested values, and lines where YAML doesn't parse."""
    from quern.sources.frontmatter import fields

    assert fields('name: "a: b # c"\ndescription: >\n  two\n  lines\n# note\ntags:\n  - x\n  - 7\nmeta: {k: [1, 2]}') == {"name": "a: b # c", "description": "two lines\n", "category": None, "tags": ["x", "7"]}
    assert fields("name: a\ndescription: first: second") == {"name": "a", "description": "first: second", "category": None, "tags": []}
    assert fields("tags: [p, 'q']\ncategory: ops") == {"name": None, "description": None, "category": "ops", "tags": ["p", "q"]}
    assert fields("") == fields(None) == fields("- just\n- a list") | {"tags": []}
    assert fields('tags: "p, q"')["tags"] == ["p", "q"]


def test_corrupt_and_existing(spark, tree):
    assert [r.path.rsplit("/", 2)[1] for r in documents.corrupt(spark, f"file://{tree}").collect()] == ["bad"]
    assert documents.existing(spark, [f"file://{tree}/a", f"file://{tree}/zz", f"file://{tree}/a/SKILL.md"]) == [f"file://{tree}/a"]


def test_numbers_in_order(spark):
    from quern.runtime import numbered

    rows = numbered(spark.range(1000).selectExpr("cast((id * 7919) % 1000 as string) as path").repartition(7), "path", "no").collect()
    assert [r.path for r in sorted(rows, key=lambda r: r.no)] == sorted(r.path for r in rows) and {r.no for r in rows} == set(range(1, 1001))


def test_guard():
    assert documents.guarded("/data/x/../y", ["/data"]) == "/data/y"
    with pytest.raises(ValueError, match="allowed"):
        documents.guarded("/data/../etc", ["/data"])


def test_guard_of_real_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in/link").symlink_to(tmp_path / "out")
    (tmp_path / "in/file").write_text("x")
    root = f"file://{tmp_path}/in"
    assert documents.guarded(root, [root], spark) == f"{tmp_path}/in"
    for bad, kind in ((f"{root}/link", ValueError), (f"{root}/none", FileNotFoundError), (f"{root}/file", NotADirectoryError)):
        with pytest.raises(kind):
            documents.guarded(bad, [root], spark)


def test_rewrite(spark):
    rows = [("p", "---\nname: a\ndescription: old\n---\nBody", "a", "new", ["t"]), ("q", "plain", "b", "d", []), ("r", "--- open", "c", "d", ["u"])]
    out = {r.path: r.new_content for r in documents.rewritten(spark.createDataFrame(rows, "path string, content string, name string, description string, tags array<string>")).collect()}
    assert out["p"] == "---\nname: a\ndescription: new\n---\n\nBody"
    assert out["q"].startswith("---\nname: b\ndescription: d\ntags: []\n---\n\nplain") and out["r"].endswith("--- open")


def test_upsert(spark):
    loads = spark.createDataFrame([(1, "a", "old", ["x"]), (2, "a", "new", ["y", "x"]), (3, "b", "only", None)], "load_seq int, name string, description string, tags array<string>")
    rows = {r.name: r for r in catalogue.upsert(loads).collect()}
    assert rows["a"].description == "new" and rows["a"].tags == ["x", "y"] and rows["b"].tags == []
    assert catalogue.upsert(loads.union(loads.where("load_seq = 2"))).count() == 2


def test_streams(spark, tmp_path):
    from conftest import SMALL

    (tmp_path / "in").mkdir()
    batch = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("timestamp"), F.lit(5).cast("bigint").alias("tokens_saved"), F.lit(7).cast("bigint").alias("latency_ms"), F.col("event_type").alias("skill_name"), (F.col("value") > 30).alias("success"))
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for k, (view, mode) in enumerate([(increments.daily_stats, "complete"), (increments.skill_weights, "complete"), (increments.auto_sessions, "append")]):
        q = view(stream).writeStream.format("memory").queryName(f"view{k}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.sql("SELECT sum(queries) FROM view0").first()[0] == batch.count()
    assert spark.sql("SELECT sum(successes + failures) FROM view1").first()[0] == batch.count()
    increments.append_log(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == batch.count()


def test_views_of_a_stream(spark, tmp_path):
    """Patterns and recent names after each batch equal the batch operators over all rows."""
    from quern.operators import learning, sessions

    rows = [(i, ["deploy cluster", "run tests"][i % 2], f"s{i % 3}", i % 5 > 1, f"2024-01-{1 + i % 20:02} 10:00:00", f"u{i % 4}") for i in range(60)]
    every = spark.createDataFrame(rows, "id long, query string, skill_name string, success boolean, at string, session_id string").withColumn("timestamp", F.col("at").cast("timestamp_ntz")).drop("at")
    names = "id", "query", "skill_name", "success", "timestamp", "session_id"
    for k in range(2):
        every.where(F.col("id") % 2 == k).select(*names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(every.select(*names).schema).parquet(f"{tmp_path}/in")
        increments.query_patterns(stream, f"{tmp_path}/log1", f"{tmp_path}/view1", f"{tmp_path}/c1").awaitTermination()
        increments.recent_skills(stream, f"{tmp_path}/log2", f"{tmp_path}/view2", f"{tmp_path}/c2", 2).awaitTermination()
    want = learning.query_patterns(every)
    assert set(increments.newest(spark, f"{tmp_path}/view1").drop("batch").collect()) == set(want.collect())
    got = increments.newest(spark, f"{tmp_path}/view2")
    recent = sessions.recent_skills(every, 2)
    assert set(got.select(recent.columns).collect()) == set(recent.collect())
