"""Operator 11 against the library, on edge cases, every bound of the table, and the smallest tables; and SQL of this subpackage."""

import hashlib
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quern.llm import pieces, queries

PATH = queries.tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "▁", "é", "the", "ing", "\n", "\t", "\0", "<0x0A>", "</s>", "中", "🙂", "ﬁ", "́", "1", "​", "the the ", "�"]


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))) for i in range(1000)]
    return [*made, (5000, None), (5001, ""), (5002, "x" * 60_000), (5003, "ab" * 20_000 + " c"), (5003, "again"), (None, "no id")]


def digest(library, text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = library.encode(text or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))


@pytest.mark.parametrize("most", [pieces.TABLE_BYTES, 3000, 0])
def test_digests(spark, library, rows, most):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("mine")).withColumn("chunk", F.lit(1))
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs, PATH, most).collect())
    assert got == sorted((i or -1, *digest(library, t)) for i, t in rows)
    assert pieces.digests(docs.limit(0), PATH, most).count() == 0


def test_encode_and_decode(spark, library, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pieces.Pieces(PATH)
    for r in pieces.encode(docs.where("doc_id < 5003"), PATH).collect():
        text = dict(rows)[r.doc_id]
        assert list(r.ids) == library.encode(text or "", add_eos=True)
        assert r.decoded == library.decode(list(r.ids)) == model.decode(r.ids) == (text or "").replace("▁", " ")


def test_each_chunk_once(spark):
    docs = spark.createDataFrame([(1, "one two  two two"), (2, "two one"), (3, "three")], "doc_id long, text string")
    counts = {bytes(r.chunk): r.n for r in pieces.counted(docs).collect()}
    assert counts == {b" one": 2, b" two": 3, b"  two": 1, b" three": 1}
    assert {bytes(r.chunk) for r in pieces.table(docs, PATH).collect()} == {b" one", b" two"}
    assert {bytes(r.chunk) for r in pieces.table(docs, PATH, most=40).collect()} == set()


def test_whole_table(spark, library):
    want = {r.doc_id: digest(library, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op11_sentencepiece"](spark, SMALL).collect()} == want


def test_refused_files(tmp_path):
    (tmp_path / "none.model").write_bytes(b"")
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "none.model"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    """Every SQL of the subpackage gives the query's rows on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    got = queries.QUERIES[name](spark, SMALL)
    assert set(got.columns) >= set(columns)
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == want
