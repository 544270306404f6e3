"""Stages of the pipeline, and the registered queries."""

import brute
from conftest import SMALL
from pyspark.sql import functions as F


def test_stages(spark):
    import corpus_pipeline
    from quern.llm import decontaminate, neardup, quality
    from quern.runtime import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, SMALL), name)
        ids = {r.doc_id for r in docs.collect()}
        left = {r.doc_id for r in out.collect()}
        if k == 0:
            assert left == {r.doc_id for r in quality.classified(docs, labels).where("kept").collect()}
        elif k == 2:
            best = brute.near([(r.doc_id, r.text) for r in docs.collect()], 5)
            assert left == {c for _, c in best.values()}
        elif k == 3:
            assert left == ids - {r.doc_id for r in decontaminate.contaminated(docs, items).collect()}
        else:
            assert left == ids
        if k < 4:
            assert out.columns == docs.columns
            if k != 1:
                assert {r.doc_id: r.text for r in out.collect()}.items() <= {r.doc_id: r.text for r in docs.collect()}.items()
        docs = out
    assert neardup.DISTANCE == 29
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, docs.collect()))


def test_stages_on_edge_cases(spark):
    """Nulls in every column, empty and long texts, repeated rows, empty tables, clashing columns: the defined result of each stage."""
    import corpus_pipeline

    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([*brute.DOCS, (7, real.where("doc_id = 7").first().text, None, None, None), (None, None, None, None, None)], real.schema)
    docs = real.unionByName(odd).unionByName(real.where("doc_id = 3")).withColumn("_removed", F.lit("mine")).withColumn("slot", F.lit(1)).withColumn("x", F.lit(2.0))
    n, texts = docs.count(), docs.where("length(text) > 0").count()
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        rows = out.count()
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if name == "bpe_encoding":
            assert rows == n and out.columns[:1] == ["doc_id"]
            continue
        assert out.columns == docs.columns
        if name == "quality_classifier":
            assert out.where("text is null or text = ''").count() == 0 and rows <= texts
        elif name == "line_dedup":
            assert rows == n and out.where("text is null").count() == docs.where("text is null").count() and out.where("text is null and n_chars is not null").count() == 0
        elif name == "minhash_near_dedup":
            want = brute.near([(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()], 5)
            assert ids(out) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id is None or want[r.doc_id][1] == r.doc_id)
        else:
            assert out.where("text is null or text = ''").count() == docs.where("text is null or text = ''").count()
    assert len(stages) == 5


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names if n[2].isdigit()} == set(range(1, 13)) and "pipeline" in entry.queries()
