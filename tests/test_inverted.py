"""What is made inside tasks equals what shuffles make, at every cut; and a load, a merge and the job's output shuffle documents at most."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from jobs import index_documents
from quern.operators import inverted, lexical, segments
from quern.operators.segments import Segments
from quern.sources import adapters

ODD = [(300, "n-300", "Ab𝒳é red  red", "İx Σας x x _ 50%", ["a%b", "é"]), (-5, "", None, None, None), (7, None, "", "one", []), (129, "x", "a", "red " * 40 + "\x00 z", ["x"]), (128, "𝒳", "\x00\x01", "Red x\nÜnder_score", None)]


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "rowid bigint, name string, description string, body string, tags array<string>")


@pytest.mark.parametrize("run", [1, 12, 10**6])
def test_made_in_tasks(spark, odd, monkeypatch, run):
    """Empty and null texts, other scripts, ids out of order and below zero, runs of a row, of some and of all."""
    monkeypatch.setattr(inverted, "RUN", run)
    tokens = lexical.tokened(odd, "rowid", "name")
    words = inverted.worded(tokens, "rowid", "name").withColumn("block", lexical.block(F.col("rowid"))).where("length > 0").coalesce(1).toArrow().to_batches()
    made = lambda f, schema, batches: spark.createDataFrame([r for b in f(iter(batches)) for r in b.to_pylist()], schema)
    postings = made(inverted._postings, inverted.POSTINGS, words)
    assert rows(postings) == rows(lexical.placed(tokens))
    impacts = made(inverted._impacts, lexical.IMPACTS, words).groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"))
    assert rows(impacts) == rows(lexical.token_impacts(tokens))
    counts = made(inverted._counts(["rowid", "name"]), f"rowid bigint, name string, {inverted.COUNTS}", words)
    names = odd.select("rowid", "name")
    assert rows(counts) == rows(lexical.placed(tokens).groupBy("rowid", "col", "term").agg(F.count("*").alias("n"), F.min("pos").cast("bigint").alias("first_pos")).join(names, "rowid").select("rowid", "name", "col", "term", "n", "first_pos"))
    lower = odd.select("rowid", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "description")]).withColumn("size", F.char_length("name") + F.char_length("description"))
    assert rows(made(inverted._grams, inverted.GRAMS, lower.coalesce(1).toArrow().to_batches())) == rows(lexical.grams(odd))
    if run > 100:  # one run: in the order of terms as Spark compares them
        assert [(r.term, r.rowid) for r in postings.collect()] == [(r.term, r.rowid) for r in postings.orderBy("term", "rowid").collect()]


def shuffled(spark):
    """Rows that stages have written to shuffles, by stage."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def test_no_postings_are_shuffled(spark, tmp_path):
    """A load of documents, some of which come twice, a merge, and the output read back: no stage shuffles more rows than there are documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*[c.split()[0] for c in index_documents.SCHEMA.split(", ")])
    docs.unionByName(docs.where("doc_id < 10")).repartition(2).write.parquet(f"file://{tmp_path}/in")
    before = shuffled(spark)
    counts = index_documents.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark", {"files": 1, "fan": 2})
    index_documents.output(spark, f"file://{tmp_path}/out").write.format("noop").mode("overwrite").save()
    assert counts["batches"] == 2 and counts["segments"] == 1 and counts["read"] == docs.count() + 10
    assert max(n for s, n in shuffled(spark).items() if s not in before) <= docs.count() + 10


def test_segments_without_words(spark, odd, tmp_path):
    """Segments written before entries kept tokens are read, merged and counted as others."""
    new, old = (Segments(spark, f"file://{tmp_path}/{x}", odd.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")) for x in ("new", "old"))
    new.add(odd.where("rowid < 200"))
    new.add(odd.where("rowid = 7").withColumn("body", F.lit("one two")), odd.where("rowid = 129").select("rowid"))
    for table in ("entries", "postings", "impacts", "grams", "sealed"):
        new._read(table).drop("words").write.partitionBy("segment").parquet(f"{old.root}/{table}")
    assert not any(r.words for r in old.sealed())
    new.add(odd.where("rowid = 300"))
    old.add(odd.where("rowid = 300"))
    want = rows(new.counts("name"))
    assert rows(old.counts("name")) == want and len(want) > 15
    old._merged(old.sealed())
    assert len(old.sealed()) == 1 and rows(old.counts("name")) == want and rows(old.index().postings) == rows(new.index().postings) and rows(old.index().lengths) == rows(new.index().lengths)


def test_merged_files(spark, tmp_path):
    """Small segments that are merged have no more files than their tokens ask for."""
    docs = adapters.documents(spark, SMALL)
    index = Segments(spark, f"file://{tmp_path}/store")
    for k in range(3):
        index.add(docs.where(F.col("rowid") % 3 == k).repartition(8))
    name = index._merged(index.sealed())
    tokens = index.index().lengths.agg(F.sum("length")).first()[0]
    files = lambda table: len(list((tmp_path / "store" / table / f"segment={name}").glob("*.parquet")))
    assert {files(t) for t in ("entries", "postings", "impacts", "grams")} == {tokens // segments.LEAST_TOKENS + 1}


def test_searches_pass_over_no_whole_table(spark, tmp_path, monkeypatch):
    """Open ends of many terms go to the reader as they are asked, and no word of short runs means no pass over all grams."""
    made = [(i, "body", f"red{i}" if i % 2 else f"other{i}", 0) for i in range(40)] + [(50, "name", "red", 0), (50, "name", "fox", 1), (51, "name", "red", 1)]
    spark.createDataFrame(made, inverted.POSTINGS).write.parquet(f"file://{tmp_path}/postings")
    index = spark.read.parquet(f"file://{tmp_path}/postings")
    phrases = spark.createDataFrame([("red", True), ("red fox", False)], "text string, prefix boolean")
    want = rows(lexical.phrase_counts(phrases, index))
    monkeypatch.setattr(lexical, "MOST_TERMS", 5)
    found = lexical.phrase_counts(phrases, index)
    assert rows(found) == want and len(want) == 23
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [rowid") == 2 and plan.count("StartsWith(term") >= 2
    spark.createDataFrame([("abc", 1), ("bcd", 1), ("abc", 2)], inverted.GRAMS).write.parquet(f"file://{tmp_path}/grams")
    grams = spark.read.parquet(f"file://{tmp_path}/grams")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    found = lexical.gram_candidates(words("abcd", "abc"), grams)
    assert rows(found) == ["Row(word='abc', rowid=1)", "Row(word='abc', rowid=2)", "Row(word='abcd', rowid=1)"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [gram") == 2  # counted and met
    assert rows(lexical.gram_candidates(words("b"), grams)) == ["Row(word='b', rowid=1)"]
