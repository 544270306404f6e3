"""Index, query, session, feedback, insights: end to end."""

import datetime

from quern.plans.engine import Engine

AT = datetime.datetime(2024, 1, 10)


def test_end_to_end(spark, tmp_path):
    bodies = {"deploy/cluster": "deploy kubernetes cluster", "deploy/image": "docker image build", "data/backup": "backup database nightly"}
    for name, text in bodies.items():
        (tmp_path / "docs" / name).mkdir(parents=True)
        (tmp_path / "docs" / name / "SKILL.md").write_text(f"---\nname: {name.replace('/', '-')}\ndescription: {text}\ncategory: {name.split('/')[0]}\ntags: [{text.split()[0]}]\n---\n{text} now")
    e = Engine(spark, f"file://{tmp_path}/store")
    assert e.index(f"file://{tmp_path}/docs") == 3 and e.index(f"file://{tmp_path}/docs") == 3
    assert Engine(spark, e.root).table("skills").count() == 3
    assert e.table("skills").count() == 3 and e.stats().count() == 2
    ask = spark.createDataFrame([(1, "docker image"), (2, "backup the database")], "qid int, query string")
    top = {r.qid: r.name for r in e.query(ask, 2, log_at=AT).where("rank = 1").collect()}
    assert top == {1: "deploy-image", 2: "data-backup"}
    assert e.query(ask, budget=10).count() >= 2 and e.query_adaptive(ask).count() >= 1
    e.session_start("s", AT)
    e.session_use("s", "data-backup", AT, success=True)
    e.session_use("s", "  ", AT)
    assert e.session_context().first().tokens == 15
    boosted = e.query(ask, 3, session="s", boost_graph=True).where("qid = 2 and rank = 1").first()
    assert "+session" in boosted.method
    e.feedback("backup the database", "data-backup", True, AT)
    assert e.feedback_stats()[0].first().total_feedback == 1
    assert "+weighted" in e.query(ask, 1, use_feedback=True).where("qid = 2").first().method
    report = e.insights(AT + datetime.timedelta(days=1))
    assert report["total"].first()[0] >= 2 and report["daily"].count() == 1
    assert {r.name for r in e.neighbors("deploy-cluster").collect()} >= {"deploy-image"}
    e.recipe_save("ops", ["deploy-image", "nothing"], ["data-backup"])
    e.recipe_save("ops", ["data-backup"], ["deploy-image"], "new")
    assert [r.name for r in e.recipe("ops").orderBy("pos").collect()] == ["data-backup", "deploy-image"]
    total, groups = e.dedup()
    assert e.optimize().count() == 3 and total.first().removed == 0 and groups.count() == 0
    assert e.recipes_load("sec:\n  description: audits\n  must: [deploy-cluster]\n  should:\n    - data-backup\n") == 1
    assert {r.name for r in e.recipe("sec").collect()} == {"deploy-cluster", "data-backup"}
    e.session_end("s", AT)


def test_index_is_kept_and_lists_differ(spark, tmp_path, monkeypatch):
    for name, text in {"a": "rotate the certificates", "b": "rotate logs", "c": "brew coffee"}.items():
        (tmp_path / "docs" / name).mkdir(parents=True)
        (tmp_path / "docs" / name / "SKILL.md").write_text(f"---\nname: {name}\ndescription: {text}\n---\nbody")
    e = Engine(spark, f"file://{tmp_path}/store")
    assert e.index_existing([f"file://{tmp_path}/docs", f"file://{tmp_path}/nowhere"]) == {f"file://{tmp_path}/docs": 3}
    rows = {r.name: r.rowid for r in e.table("skills").collect()}
    assert rows == {"a": 1, "b": 2, "c": 3}
    made = []
    monkeypatch.setattr("quern.operators.lexical.postings", lambda docs: made.append(docs))
    ask = spark.createDataFrame([(1, "rotate certificates")], "qid int, query string")
    for engine in (e, Engine(spark, e.root)):
        found = {m: [r.name for r in engine.query(ask, 3, method=m).orderBy("rank").collect()] for m in ("rrf", "bm25", "embed")}
        assert {x[0] for x in found.values()} == {"a"} and "c" not in found["bm25"]
    assert not made
    assert e.tools()["query"](ask, method="none")["type"] == "ValueError" and "Ask first" in e.tools()["guide"]()


def test_optimize_a_folder(spark, tmp_path):
    """A dry run leaves files; applying writes them; files that can't be read are reported and others go on."""
    for name, text in {"a": "---\nname: a\ndescription: x\n---\nDeploy the cluster with secrets s3cr3t", "b": "---\nname: b\n---\nbackup tables"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(text)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/SKILL.md").write_bytes(b"\xff\xfe")
    e = Engine(spark, f"file://{tmp_path}/store")
    before = (tmp_path / "a/SKILL.md").read_text()
    dry = {r.path.rsplit("/", 2)[1]: r for r in e.optimize_folder(f"file://{tmp_path}").collect()}
    assert set(dry) == {"a", "b", "bad"} and dry["a"].changed and not dry["bad"].changed and dry["bad"].error == "not UTF-8"
    assert (tmp_path / "a/SKILL.md").read_text() == before
    done = e.optimize_folder(f"file://{tmp_path}", apply=True)
    new = (tmp_path / "a/SKILL.md").read_text()
    assert f"description: {dry['a'].description}" in new and "s3cr3t" not in new.split("---")[1] and new.endswith("s3cr3t")
    from quern.operators import optimize

    assert optimize.totals(done).first().errors == 1 and optimize.totals(done).first().changed == 2
