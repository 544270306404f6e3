"""SQL table functions give what the engine's tools give."""

import datetime

from quern.plans import sql
from quern.plans.engine import Engine

AT = datetime.datetime(2024, 1, 10)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_functions_equal_tools(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    sql.register(e)  # of nothing
    assert all(spark.sql(f"SELECT * FROM {x}").count() == 0 for x in ("skill_list()", "skill_stats()", "skill_neighbors('a')", "skill_recipe('r')", "skill_recent('s')", "skill_rates()"))
    for k in range(4):
        (tmp_path / "docs" / f"g{k % 2}" / f"d{k}").mkdir(parents=True)
        (tmp_path / "docs" / f"g{k % 2}" / f"d{k}" / "SKILL.md").write_text(f"---\nname: d{k}\ndescription: text {k}\ncategory: g{k % 2}\ntags: [a, b{k % 2}]\n---\n{'body ' * (k + 1)}")
    e.index(f"file://{tmp_path}/docs")
    for k, (name, ok) in enumerate([("d1", True), ("d2", None), ("d1", False), ("d3", True)]):
        at = AT + datetime.timedelta(minutes=k)
        e.session_use("s", name, at, success=ok)
        e.feedback("some words", name, bool(ok), at)
    e.recipe_save("r", ["d3", "nothing"], ["d0"])
    e.query(spark.createDataFrame([(1, "text")], "qid int, query string"), 3, "bm25", log_at=AT)
    sql.register(e)
    ask = spark.sql
    listed = e.list().select("name", "use_count").collect()
    assert [(r.name, r.use_count) for r in ask("SELECT * FROM skill_list() ORDER BY rank").collect()] == [tuple(r) for r in listed]
    assert [r.name for r in ask("SELECT * FROM skill_list('g1', 1)").collect()] == [e.list("g1").first().name]
    assert rows(ask("SELECT * FROM skill_stats()"), "category", "cnt", "meta_tokens", "body_tokens") == rows(e.stats(), "category", "cnt", "meta_tokens", "body_tokens")
    columns = "name", "weight", "edge_type"
    assert rows(ask("SELECT * FROM skill_neighbors('d1')"), *columns) == rows(e.neighbors("d1"), *columns) != []
    kind = e.neighbors("d1").first().edge_type
    assert rows(ask(f"SELECT * FROM skill_neighbors('d1', edge_type => '{kind}')"), *columns) == rows(e.neighbors("d1", [kind]), *columns)
    columns = "pos", "name", "tokens", "total_tokens"
    assert rows(ask("SELECT * FROM skill_recipe('r')"), *columns) == rows(e.recipe("r"), *columns) != []
    assert rows(ask("SELECT * FROM skill_recipe('r', false)"), *columns) == rows(e.recipe("r", False), *columns)
    assert [r.skill_name for r in ask("SELECT * FROM skill_recent('s', 2) ORDER BY place").collect()] == ["d3", "d1"]
    columns = "skill_name", "successes", "failures", "rate"
    assert rows(ask("SELECT * FROM skill_rates()"), *columns) == rows(e.feedback_stats()[1], *columns) != []
    top = e.insights(AT + datetime.timedelta(days=1))["top_skills"]
    assert rows(ask("SELECT * FROM skill_top(TIMESTAMP_NTZ '2024-01-11 00:00:00')"), "skill_name", "cnt") == rows(top, "skill_name", "cnt") != []
    assert ask("SELECT * FROM skill_top(TIMESTAMP_NTZ '2024-03-11 00:00:00')").count() == 0
