"""The segmented index, block bounds and grams: equal to a plain rebuild, whatever has been added, changed, deleted or merged."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quern.operators import lexical, segments, topk
from quern.operators.segments import Segments
from quern.plans.engine import Engine
from quern.sources import adapters

ASKED = [(1, "apache license version"), (2, "pathetic worthless"), (3, "of la"), (4, "licensed-under it"), (5, "zzz")]


@pytest.fixture(scope="module")
def docs(spark):
    return adapters.documents(spark, SMALL).cache()


@pytest.fixture(scope="module")
def ask(spark):
    return spark.createDataFrame(ASKED, "qid int, query string")


def rows(frame):
    return sorted(map(str, frame.collect()))


def rebuilt(docs, ask):
    index = lexical.Index(lexical.postings(docs), lexical.doc_stats(docs, lexical.postings(docs)), None, lexical.grams(docs))
    return rows(lexical.search(ask, docs, 10, index=index))


def state(index, ask):
    return rows(lexical.search(ask, index.catalogue(), 10, index=index.index()))


def test_adds_changes_and_deletes(spark, docs, ask, tmp_path):
    index = Segments(spark, f"file://{tmp_path}/store")
    assert index.catalogue().count() == 0 and state(index, ask) == []
    for k in range(0, 150, 50):
        index.add(docs.where(f"rowid >= {k} and rowid < {k + 50}"))
    new = docs.where("rowid in (3, 120)").withColumn("body", F.lit("apache apache licensed under"))
    index.add(new, docs.where("rowid in (4, 101, 9999)").select("rowid"))
    index.add(docs.where("rowid = 4"))  # it comes back
    now = docs.where("rowid < 150 and rowid not in (3, 120, 101)").unionByName(new)
    want = rebuilt(now, ask)
    assert state(index, ask) == want and rows(index.catalogue().select(docs.columns)) == rows(now)
    seen = Segments(spark, index.root)
    assert seen.merge(2) and state(seen, ask) == want == state(index, ask)
    assert len(seen.sealed()) < 5 and not seen.merge(99)
    only = seen.index()
    assert only.corpus.first().total == now.count() and only.lengths.count() == now.count()


def test_writes_in_proportion_to_the_batch(spark, docs, tmp_path):
    index = Segments(spark, f"file://{tmp_path}/store")
    index.add(docs)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    index.add(docs.where("rowid = 7"))
    after = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    assert {f: after[f] for f in before} == before
    size = lambda files: sum(f.stat().st_size for f in files if "sealed" not in str(f))
    assert size(set(after) - set(before)) < size(before) / 10


def test_dead_and_second_writers(spark, docs, ask, tmp_path):
    """What a writer left before its last step isn't there for readers, and doesn't keep others from writing."""
    one, two = Segments(spark, f"file://{tmp_path}/store"), Segments(spark, f"file://{tmp_path}/store")
    one.add(docs.where("rowid < 60"))
    want = state(two, ask)
    dying = Segments(spark, one.root)
    dying._seal = lambda *_: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError, match="gone"):
        dying.add(docs.where("rowid >= 60"))
    assert state(two, ask) == want
    two.add(docs.where("rowid >= 60 and rowid < 80"))
    one.add(docs.where("rowid >= 80 and rowid < 90"))
    assert state(one, ask) == state(two, ask) == rebuilt(docs.where("rowid < 90"), ask)


def test_same_batch_again(spark, docs, ask, tmp_path):
    index = Segments(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        for k in range(3):
            index.add(docs.where(F.col("rowid") % 3 == k), name=f"{k:012d}")
        index.merge(3)
    assert state(index, ask) == rebuilt(docs, ask) and len(index.sealed()) == 1


@pytest.mark.parametrize("top_k", [1, 3, 10, 1000])
@pytest.mark.parametrize("rows_of_a_block", [128, 8])
def test_block_bounds(spark, docs, ask, monkeypatch, top_k, rows_of_a_block):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", rows_of_a_block)
    phrases = lexical.strategies(ask).where("strategy = 2")
    index, lengths = lexical.postings(docs).cache(), lexical.doc_stats(docs, lexical.postings(docs)).cache()
    found, report = topk.search(phrases, lexical.Index(index, lengths), lexical.impacts(index, lengths), top_k)
    every = sorted(((r.qid, -round(r.bm25, topk.DIGITS), r.rowid) for r in lexical.bm25(phrases, index, lengths).collect()))
    want = [(q, i + 1, r, -s) for q in {x[0] for x in every} for i, (_, s, r) in enumerate([x for x in every if x[0] == q][:top_k])]
    assert sorted((r.qid, r["rank"], r.rowid, r.bm25) for r in found.collect()) == sorted(want)
    blocks = {r.qid: (r.blocks, r.read) for r in report.collect()}
    assert all(read <= n for n, read in blocks.values())
    if rows_of_a_block == 8 and top_k == 1:
        # a word that half of the blocks have, and not all of these are read
        word = lexical.impacts(index, lengths).groupBy("term").agg(F.count("*").alias("n")).where("n < 13 and length(term) > 3").orderBy(F.desc("n"), "term").first()
        asked = lexical.strategies(spark.createDataFrame([(1, word.term)], "qid int, query string")).where("strategy = 2")
        best = lexical.bm25(asked, index, lengths).orderBy(F.desc("bm25"), "rowid").first()
        found, report = topk.search(asked, lexical.Index(index, lengths), lexical.impacts(index, lengths), 1)
        assert found.first().rowid == best.rowid and report.first().blocks == word.n > report.first().read


def test_block_bounds_of_segments(spark, docs, ask, tmp_path):
    index = Segments(spark, f"file://{tmp_path}/store")
    index.add(docs)
    index.add(docs.where("rowid % 3 = 0").withColumn("body", F.lit("license of the stupid")))
    phrases = lexical.strategies(ask).where("strategy = 2")
    impacts, exact = index.impacts()
    found = topk.search(phrases, index.index(), impacts, 5, exact)[0]
    every = index.index()
    want = lexical.bm25(phrases, every.postings, every.lengths).withColumn("bm25", F.round("bm25", topk.DIGITS)).collect()
    best = {(q, tuple(sorted(((-r.bm25, r.rowid) for r in want if r.qid == q))[:5])) for q in {r.qid for r in want}}
    got = found.collect()
    assert {(q, tuple(sorted((-r.bm25, r.rowid) for r in got if r.qid == q))) for q in {r.qid for r in got}} == best and not exact


def test_grams(spark):
    """Short words, wildcards, signs and letters of other scripts, and no nested loop in the plan."""
    names = ["abc", "ABCdef", "a", "", "xaby", "a_c", "50%", "Éa", "back\\slash", "straße", "ab\ncd"]
    made = [(i, n, d) for i, (n, d) in enumerate([*[(n, "some text") for n in names], *[("none", n) for n in names], (None, None)])]
    docs = spark.createDataFrame(made, "rowid long, name string, description string")
    asked = ["abc", "ab", "a", "b", "a_c", "_", "%", "50%", "é", "xab y", "STRASSE", "straß", "zz", "me t", "__", "a%c", "ab_cd"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    words = lexical.like_patterns(queries)
    got = lexical.like_supplement(queries, docs, 100, lexical.grams(docs))
    every = words.crossJoin(docs).where("name ilike concat('%', word, '%') or description ilike concat('%', word, '%')").select("qid", "rowid").distinct()
    assert rows(got) == rows(every) and got.count() > 40
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_engines_on_one_folder(spark, tmp_path):
    (tmp_path / "docs/a").mkdir(parents=True)
    (tmp_path / "docs/a/SKILL.md").write_text("---\nname: a\ndescription: rotate keys\ntags: [x]\n---\nbody")
    one, two = (Engine(spark, f"file://{tmp_path}/store") for _ in range(2))
    (tmp_path / "store/recipes").mkdir(parents=True)  # a writer died here
    (tmp_path / "store/recipes/_temporary").mkdir()
    one.recipe_save("r", ["a"])
    two.recipe_save("r", ["b"], description="newer")
    two.recipe_save("s", ["a"])
    assert {(r.recipe, r.description) for r in one.table("recipes").collect()} == {("r", "newer"), ("s", "")}
    one.index(f"file://{tmp_path}/docs")
    (tmp_path / "docs/a/SKILL.md").write_text("---\nname: a\ndescription: rotate logs\ntags: [y]\n---\nbody")
    two.index(f"file://{tmp_path}/docs")
    assert [(r.name, r.description, r.tags, r.rowid) for r in one.table("skills").collect()] == [("a", "rotate logs", ["x", "y"], 1)]


def test_an_index_splits_texts_once_and_takes_long_lines(spark, tmp_path, monkeypatch):
    """Grams of a line of 200,000 characters: quadratic work would take hours; and postings, lengths and bounds are made of tokens that are kept."""
    line = "Ab𝒳é " * 40_000
    docs = spark.createDataFrame([(1, "a", line, ["en"], "x y x"), (2, "", None, [], None)], "rowid bigint, name string, description string, tags array<string>, body string")
    found = {r.rowid: set() for r in docs.collect()}
    for r in lexical.grams(docs).collect():
        assert r.gram not in found[r.rowid]
        found[r.rowid].add(r.gram)
    runs = lambda t: {(t + "\x01\x01")[i : i + 3] for i in range(max(len(t), 1))}
    assert found == {1: runs("a") | runs(line.lower()), 2: runs("")}
    docs.write.parquet(f"file://{tmp_path}/docs")
    split = []
    monkeypatch.setattr(lexical, "tokened", lambda *a, made=lexical.tokened: split.append(1) or made(*a))
    kept = spark.read.parquet(f"file://{tmp_path}/docs")
    index = lexical.indexed(kept)
    bounds = lexical.kept_impacts(kept)
    assert split == [1]
    assert rows(index.postings) == rows(lexical.postings(docs)) and rows(index.lengths) == rows(lexical.doc_stats(docs, lexical.postings(docs)))
    assert rows(bounds) == rows(lexical.impacts(index.postings, index.lengths))


@pytest.mark.parametrize("most", [0, 300_000])
def test_a_segment_splits_its_batch_once_and_merges_without_joining_all(spark, docs, tmp_path, monkeypatch, most):
    """Replaced rows are sent to tasks, or joined where there are many: the same index."""
    monkeypatch.setattr(segments, "MOST_DEAD", most)
    split = []
    monkeypatch.setattr(lexical, "tokened", lambda *a, made=lexical.tokened: split.append(1) or made(*a))
    index = Segments(spark, f"file://{tmp_path}/store")
    few = docs.where("rowid < 20")
    index.add(few)
    index.add(few.where("rowid = 3").withColumn("body", F.lit("apache")), few.where("rowid = 4").select("rowid"))
    assert split == [1, 1]
    now = few.where("rowid not in (3, 4)").unionByName(few.where("rowid = 3").withColumn("body", F.lit("apache")))
    want = rows(lexical.postings(now))
    assert rows(index.index().postings) == want
    index._merged(index.sealed())  # the sizes differ, so merge() would leave them
    assert len(index.sealed()) == 1 and rows(index.index().postings) == want and rows(index.catalogue().select(docs.columns)) == rows(now)


def test_a_scan_finds_what_the_index_finds(spark, monkeypatch):
    """Without an index each text is split once, no postings of other words are made, and results are those of the whole index."""
    docs = spark.createDataFrame([(k, f"n-{k}", f"Ünder_score {k} red fox", f"red fox {'den ' * k}İx Σας 50% redder\nfox", ["a%b"]) for k in range(12)] + [(99, None, None, None, None)], "rowid long, name string, description string, body string, tags array<string>")
    queries = spark.createDataFrame([(1, "red fox"), (2, "under_score"), (3, "den ix redder"), (4, "of"), (5, "n-1 50%"), (6, "")], "qid int, query string")
    whole = lexical.Index(lexical.postings(docs), lexical.doc_stats(docs, lexical.postings(docs)), None, lexical.grams(docs))
    want = rows(lexical.search(queries, docs, 20, index=whole))
    made = []
    monkeypatch.setattr(lexical, "indexed", lambda *a, **k: made.append(1) or whole)
    assert rows(lexical.search(queries, docs, 20)) == want and not made
    few = lexical.scanned(docs, lexical.strategies(queries).where("strategy = 1"))
    terms = {r.term for r in few.postings.select("term").distinct().collect()}
    assert terms == {"red", "fox", "den", "redder"}
    assert rows(few.lengths) == rows(lexical.doc_stats(docs, lexical.postings(docs)))
    monkeypatch.setattr(lexical, "MOST_TERMS", 2)  # too many words for a scan
    assert rows(lexical.search(queries, docs, 20)) == want and made
