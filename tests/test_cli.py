"""The command line, the fall-back to words, title case and score bars."""

import json

from pyspark.sql import functions as F

from quern import cli
from quern.functions.text import percent, score_bar
from quern.operators.optimize import title_case
from quern.plans.engine import Engine


def test_commands(spark, tmp_path, capsys):
    for name, text in {"ops/deploy": "deploy the kubernetes cluster", "data/backup": "backup the database"}.items():
        (tmp_path / "docs" / name).mkdir(parents=True)
        (tmp_path / "docs" / name / "SKILL.md").write_text(f"---\nname: {name.split('/')[1]}\ndescription: {text}\ntags: [a, b, c]\n---\nbody")
    store = f"file://{tmp_path}/store"

    def call(*args, code=0):
        assert cli.main(["--store", store, *args], spark) == code
        return capsys.readouterr()

    assert call("index", f"file://{tmp_path}/docs").out == "2 documents\n"
    lines = call("query", "kubernetes cluster", "--top", "1", "--no-feedback").out.split("\n")
    assert lines[0] == "1. deploy" and lines[1].endswith("[a, b]") and lines[2].startswith("[") and "░" in lines[2]
    found = json.loads(call("--format", "json", "query", "backup", "--method", "bm25").out.split("\n")[0])
    assert found["name"] == "backup" and found["rank"] == 1
    assert "s1" in call("session", "start", "--id", "s1").out and "s1" in call("session", "use", "backup", "--id", "s1", "--success", "true").out
    assert "backup" in call("session", "context").out and "s1" in call("session", "end", "--id", "s1").out
    assert "backup" in call("feedback", "record", "save the tables", "backup").out and call("feedback", "stats").out.startswith("1\t1.0")
    assert call("list").out.split("\n")[0].split("\t")[:3] == ["backup", "uncategorized", "2"]
    assert "uncategorized\t2" in call("stats").out and call("insights").out and "Ask first" in call("guide").out
    assert "deploy" in call("optimize", f"file://{tmp_path}/docs").out and "deploy" in call("adaptive", "deploy cluster").out
    assert call("neighbors", "deploy").out is not None and call("dedup").out.startswith("2\t0") and call("recipe", "none").out == ""
    assert call("query", "x", "--method", "none", code=1).err.startswith("error: method none")


def test_words_when_vectors_fail(spark, tmp_path):
    (tmp_path / "docs/a").mkdir(parents=True)
    (tmp_path / "docs/a/SKILL.md").write_text("---\nname: a\ndescription: rotate keys\n---\nbody")
    e = Engine(spark, f"file://{tmp_path}/store")
    e.index(f"file://{tmp_path}/docs")

    def broken(texts):
        return texts.select("id", F.raise_error(F.lit("no model")).cast("array<double>").alias("embedding"))

    ask = spark.createDataFrame([(1, "rotate keys")], "qid int, query string")
    for embed in (broken, lambda texts: 1 / 0):
        other = Engine(spark, e.root, embed=embed)
        for method in ("rrf", "embed"):
            assert [(r.name, r.method) for r in other.query(ask, 3, method).collect()] == [("a", "bm25")]


def test_title_case(spark):
    names = ["k8s-DNS", "don't", "x", "", "éa 2nd_b", "ABC def9ghi"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(title_case(F.col("n"))).collect()]
    assert got == [n.title() for n in names]


def test_score_bar(spark):
    scores = [0.0, 0.05, 0.1, 0.85, 0.999, 1.0, 1.27, 0.29]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select(percent(F.col("s")), score_bar(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(int(s * 100), "█" * min(int(s * 100) // 10, 10) + "░" * max(10 - int(s * 100) // 10, 0)) for s in scores]
