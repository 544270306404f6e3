"""The jobs: against their SQL, two runs over growing input, reruns, replays after a failure, command lines."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT, SMALL
from pyspark.sql import functions as F
from test_catalogue import plain

from jobs import common, index_documents, registered, usage_report
from quern.operators import lexical, segments

SCHEMA = index_documents.SCHEMA


def rows(frame):
    return sorted((tuple(plain(v) for v in r) for r in frame.select(sorted(frame.columns)).collect()), key=str)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_registered(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(registered.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    before = spark.conf.getAll
    got = registered.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert rows(got) == sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall()), key=str)
    assert spark.conf.getAll == before


def report(spark, folder):
    return rows(spark.read.parquet(f"{folder}/days")), rows(spark.read.parquet(f"{folder}/skills"))


def test_report_of_some_days(spark, tmp_path):
    """A range replaces its own days alone, with what the whole log would give; a rerun changes nothing."""
    log = f"file://{tmp_path}/log"
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.where("event_id % 3 > 0 or ts < '2024-01-10'").write.parquet(log)
    odd = spark.createDataFrame([(-1, None, 1, "view", 1.0, "{}"), (-2, None, None, "  ", None, None)], events.schema)
    odd.write.mode("append").parquet(log)
    out, whole = f"file://{tmp_path}/out", f"file://{tmp_path}/whole"
    usage_report.run(spark, log, out)
    first = report(spark, out)
    late = events.where("event_id % 3 = 0 and ts >= '2024-01-10'")
    late.write.mode("append").parquet(log)
    for _ in range(2):
        counts = usage_report.run(spark, log, out, {"from": "2024-01-12", "to": "2024-01-15"})
        assert counts["read"] == events.where("ts >= '2024-01-12' and ts < '2024-01-15'").count() and counts["days"] == 3
        mended = report(spark, out)
        assert [r for r in first[0] if str(r) not in map(str, mended[0])] and len(mended[0]) == len(first[0])
    usage_report.run(spark, log, whole)
    day = sorted(spark.read.parquet(f"{whole}/days").columns).index("date")
    inside = lambda r: "2024-01-12" <= str(r[day]) < "2024-01-15"
    assert [r for r in mended[0] if inside(r)] == [r for r in report(spark, whole)[0] if inside(r)]
    assert [r for r in mended[0] if not inside(r)] == [r for r in first[0] if not inside(r)]
    usage_report.run(spark, log, out)
    assert report(spark, out) == report(spark, whole)


def search(spark, folder):
    ask = spark.createDataFrame([(1, "apache license version"), (2, "pathetic worthless stupid")], "qid int, query string")
    index = segments.Segments(spark, folder)
    return rows(lexical.search(ask, index.catalogue(), 10, index=index.index()))


def test_growing_collection(spark, tmp_path):
    """Two runs over growing input read each file once and end as one run over everything would; so does a batch that runs again."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    folder, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    docs.where("doc_id < 120").repartition(5).write.parquet(folder)
    first = index_documents.run(spark, folder, out, mark, {"files": 1, "fan": 3})
    assert first["batches"] == 5 and first["read"] == 120 and first["segments"] < 5
    assert index_documents.run(spark, folder, out, mark)["batches"] == 0
    # new ones, a changed one, a deleted one, one that comes twice, one without an id
    new = docs.where("doc_id >= 120").unionByName(docs.where("doc_id = 7").withColumn("text", F.lit("apache apache license")))
    new = new.unionByName(docs.where("doc_id = 130")).unionByName(spark.createDataFrame([(9, None, "en", "src1", None), (None, "stray", "en", "src1", 5)], SCHEMA))
    new.repartition(1).write.mode("append").parquet(folder)
    second = index_documents.run(spark, folder, out, mark)
    assert second["batches"] == 1 and second["read"] == new.count()
    after = docs.where("doc_id not in (7, 9)").unionByName(new.where("doc_id = 7"))
    after.repartition(1).write.parquet(f"file://{tmp_path}/all")
    once = f"file://{tmp_path}/once"
    index_documents.run(spark, f"file://{tmp_path}/all", once, f"file://{tmp_path}/mark2")
    want, found = rows(index_documents.output(spark, once)), search(spark, once)
    assert rows(index_documents.output(spark, out)) == want and search(spark, out) == found and found
    # the last batch's commit is lost: it runs again, into the same segment
    for p in (tmp_path / "mark" / "commits").iterdir():
        if p.name.strip(".").split(".")[0] == "5":
            p.unlink()
    assert index_documents.run(spark, folder, out, mark)["batches"] == 1
    assert rows(index_documents.output(spark, out)) == want and search(spark, out) == found


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"fan": 0}')
    assert common.read_config(spark, f"file://{tmp_path}/c.json", index_documents.DEFAULTS) == {"files": 1000, "fan": 0}
    (tmp_path / "c.json").write_text('{"fun": 0}')
    with pytest.raises(ValueError, match="fun"):
        common.read_config(spark, f"file://{tmp_path}/c.json", index_documents.DEFAULTS)
    for job in (index_documents, usage_report):
        assert json.loads((ROOT / "jobs" / f"{job.__name__.split('.')[1]}.json").read_text()) == job.DEFAULTS


@pytest.mark.parametrize(("job", "paths"), [("usage_report", ["events"]), ("index_documents", ["documents", "checkpoint"])])
def test_command_line(tmp_path, job, paths):
    args = [f"--output={tmp_path}/out", *[f"--{p}=" + (f"{tmp_path}/mark" if p == "checkpoint" else f"{SMALL}/{p}.parquet{'*' if p == 'documents' else ''}") for p in paths]]
    done = subprocess.run([sys.executable, ROOT / "jobs" / f"{job}.py", f"--config={ROOT}/jobs/{job}.json", *args], capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "wrote" in done.stderr and any((tmp_path / "out").iterdir())
