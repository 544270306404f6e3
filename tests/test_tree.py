"""The data source of documents: what it finds, and that files stay whole."""

import pytest
from pyspark.sql import functions as F

from quern.sources import documents, tree


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_underscore_and_deep_folders(spark, tmp_path, monkeypatch):
    files = {f"{p}/SKILL.md": p for p in ("_drafts/a", "b/c/d/e/f", "_x", "k/node_modules2", *[f"many/{i}" for i in range(90)])}
    put(tmp_path, files | {"SKILL.md": "root", "k/node_modules/z/SKILL.md": "skip", "k/.git/SKILL.md": "skip", "k/other.md": "skip"})
    got = {r.path: r.content for r in documents.scan(spark, f"file://{tmp_path}").collect()}
    assert got == {f"file:{tmp_path}/{name}": text for name, text in (files | {"SKILL.md": "root"}).items()}
    assert [r.content for r in documents.scan(spark, str(tmp_path), recursive=False).collect()] == ["root"]
    parts = tree.Reader(str(tmp_path), "SKILL.md", [], True).partitions()
    assert 60 < len(parts) <= tree.FOLDERS and len({x for p in parts for x in p.paths}) == sum(len(p.paths) for p in parts)
    assert documents.scan(spark, f"file://{tmp_path}/many/3").count() == 1
    (tmp_path / "empty").mkdir()
    assert documents.scan(spark, f"file://{tmp_path}/empty").count() == 0


def test_writing(spark, tmp_path):
    put(tmp_path, {f"{i}/SKILL.md": f"old {i}" for i in range(20)})
    new = spark.createDataFrame([(f"file:{tmp_path}/{i}/SKILL.md", f"new {i}") for i in range(15)] + [(f"file:{tmp_path}/gone/SKILL.md", "x"), ("file:/elsewhere/SKILL.md", "y")], "path string, new_content string").repartition(6)
    errors = {r.path: r.error for r in documents.applied(spark, new, f"file://{tmp_path}").collect()}
    assert set(errors) == {f"file:{tmp_path}/gone/SKILL.md", "file:/elsewhere/SKILL.md"}
    assert [(tmp_path / str(i) / "SKILL.md").read_text() for i in range(20)] == [f"new {i}" if i < 15 else f"old {i}" for i in range(20)]
    assert not [f for f in tmp_path.rglob("*") if "draft" in f.name]
    assert documents.applied(spark, new.where("path like '%/3/%'"), f"file://{tmp_path}").count() == 0


def test_a_failed_task_leaves_all_files(spark, tmp_path):
    put(tmp_path, {f"{i}/SKILL.md": f"old {i}" for i in range(12)})
    text = F.when(F.col("i") == 11, F.raise_error(F.lit("lost"))).otherwise(F.concat(F.lit("new "), F.col("i").cast("string")))
    new = spark.range(12).repartition(4, "id").select(F.col("id").alias("i")).select(F.format_string(f"file:{tmp_path}/%d/SKILL.md", "i").alias("path"), text.cast("string").alias("new_content"))
    with pytest.raises(Exception, match="lost"):
        documents.applied(spark, new, f"file://{tmp_path}")
    assert all((tmp_path / str(i) / "SKILL.md").read_text() == f"old {i}" for i in range(12))
