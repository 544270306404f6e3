"""Postings, block bounds, grams and counts of rows with their tokens, made batch by batch inside the tasks that read them: nothing is shuffled.

Each function maps Arrow batches. A batch is cut into runs of about RUN tokens (or characters); what a run gives is sorted, so a file
holds some sorted runs, and a reader of a few terms skips the pages of others in each. Nothing larger than a batch is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import lexical
from quern.runtime import ship_code

RUN = 1_000_000
POSTINGS = "rowid bigint, col string, term string, pos int"
GRAMS = "gram string, rowid bigint"
WORDS = "words array<struct<col: string, words: string>>"
COUNTS = "col string, term string, n bigint, first_pos bigint"
#: Code points are numbered from 1, so that 0 stands for none; three of them make a key.
_BITS = 21


def _runs(batches: Iterator[pa.RecordBatch], size: str) -> Iterator[pa.RecordBatch]:
    """Batches in order of rowid, cut where the sum of a column passes RUN; a row is never cut."""
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("rowid").to_numpy()
        if (ids[1:] < ids[:-1]).any():
            b = b.take(pa.array(np.argsort(ids, kind="stable")))
        of = np.cumsum(b.column(size).to_numpy()) // RUN
        ends = [*(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), b.num_rows]
        for begin, end in zip([0, *ends], ends, strict=False):
            yield b.slice(begin, end - begin)


def _first(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


class _Occurrences:
    """The tokens of a batch one after another: `list_of` numbers the list that each stands in, `pos` its place there, `rank` its term in the order of terms."""

    def __init__(self, batch: pa.RecordBatch):
        words = batch.column("words")
        each = words.flatten()
        some = pc.not_equal(each.field("words"), "")
        self.row_of_list = np.repeat(np.arange(batch.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))[some.to_numpy(zero_copy_only=False)]
        self.columns = each.field("col").filter(some)
        tokens = pc.split_pattern(each.field("words").filter(some), " ")
        sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        self.list_of = np.repeat(np.arange(len(sizes)), sizes)
        self.pos = np.arange(len(self.list_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = tokens.flatten().dictionary_encode()
        order = pc.sort_indices(found.dictionary).to_numpy()  # by bytes, as Spark sorts
        self.terms = found.dictionary.take(pa.array(order))
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        self.rank = ranks[found.indices.to_numpy()]


def _taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    return values.take(pa.array(at))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _runs(batches, "length"):
        o = _Occurrences(b)
        n = max(len(o.rank), 1)
        at = np.sort(o.rank * n + np.arange(len(o.rank))) % n
        where = o.list_of[at]
        rows = b.column("rowid").to_numpy()[o.row_of_list[where]]
        yield pa.RecordBatch.from_arrays([pa.array(rows), _taken(o.columns, where), _taken(o.terms, o.rank[at]), pa.array(o.pos[at].astype(np.int32))], names=["rowid", "col", "term", "pos"])


def _impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _runs(batches, "length"):
        o = _Occurrences(b)
        if not len(o.rank):
            continue
        rows, columns = b.num_rows, o.columns.dictionary_encode()
        weights = np.array([lexical.WEIGHTS[c] for c in columns.dictionary.to_pylist()])
        kinds = len(weights)
        keys = np.sort((o.rank * rows + o.row_of_list[o.list_of]) * kinds + columns.indices.to_numpy()[o.list_of])
        worth, keys = weights[keys % kinds], keys // kinds
        at = _first(keys)
        f, rank, row = np.add.reduceat(worth, at), keys[at] // rows, keys[at] % rows
        # rows are in order of rowid, so a term's rows of one block are neighbours
        block, length = b.column("block").to_numpy()[row], b.column("length").to_numpy()[row]
        at = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (block[1:] != block[:-1])]))
        n = np.diff(np.append(at, len(rank)))
        yield pa.RecordBatch.from_arrays([_taken(o.terms, rank[at]), pa.array(block[at]), pa.array(n), pa.array(np.maximum.reduceat(f, at)), pa.array(np.minimum.reduceat(length, at))], names=["term", "block", "n", "most", "least"])


def _counts(passed: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, "length"):
            o = _Occurrences(b)
            terms, most = max(len(o.terms), 1), int(o.pos.max(initial=0)) + 1
            keys = np.sort((o.list_of * terms + o.rank) * most + o.pos)
            at = _first(keys // most)
            first, keys = keys[at] % most, keys[at] // most
            where = keys // terms
            rows = o.row_of_list[where]
            values = [_taken(o.columns, where), _taken(o.terms, keys % terms), pa.array(np.diff(np.append(at, len(o.pos)))), pa.array(first)]
            yield pa.RecordBatch.from_arrays([*[_taken(b.column(c), rows) for c in passed], *values], names=[*passed, "col", "term", "n", "first_pos"])

    return counted


def _text(keys: np.ndarray) -> list[str]:
    """Grams of keys; a 0 is no character."""
    points = np.stack([keys >> 2 * _BITS, keys >> _BITS & (1 << _BITS) - 1, keys & (1 << _BITS) - 1], axis=1)
    return ["".join(chr(c - 1) for c in row if c) for row in points.tolist()]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _runs(batches, "size"):
        texts = [t for c in ("name", "description") for t in b.column(c).to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 2)
        # each text is followed by two that fill up its last grams; an empty one has a gram of these two alone
        points = np.frombuffer("".join(t + lexical.GRAM_END * 2 for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        each = np.maximum(sizes, 1)
        of = np.repeat(np.arange(len(texts)), each)
        at = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(ends - sizes - 2, each)
        third = np.where(np.repeat(sizes, each) > 0, points[np.minimum(at + 2, len(points) - 1)], 0)
        keys, which = np.unique(points[at] << 2 * _BITS | points[at + 1] << _BITS | third, return_inverse=True)
        pairs = np.sort(which * b.num_rows + of % b.num_rows)
        pairs = pairs[_first(pairs)]
        yield pa.RecordBatch.from_arrays([_taken(pa.array(_text(keys), pa.string()), pairs // b.num_rows), pa.array(b.column("rowid").to_numpy()[pairs % b.num_rows])], names=["gram", "rowid"])


def worded(tokens: DataFrame, *columns: str) -> DataFrame:
    """`words` for `lists` of lexical.tokened(), `length` and more columns: a list as one string, which costs a reader far less. Tokens hold no spaces."""
    return tokens.select(*columns, "length", F.transform("lists", lambda c: F.struct(c["col"].alias("col"), F.array_join(c["tokens"], " ").alias("words"))).alias("words"))


def _full(tokens: DataFrame) -> DataFrame:
    ship_code(tokens.sparkSession)
    return tokens.where("length > 0")


def postings(tokens: DataFrame) -> DataFrame:
    """lexical.placed() of worded(), in the order of terms and rows within a run."""
    return _full(tokens).select("rowid", "words", "length").mapInArrow(_postings, POSTINGS)


def impacts(tokens: DataFrame) -> DataFrame:
    """lexical.token_impacts(), in the order of terms within a run; a block whose rows lie in several runs has a bound in each."""
    return _full(tokens).select("rowid", "words", "length", lexical.block(F.col("rowid")).alias("block")).mapInArrow(_impacts, lexical.IMPACTS)


def grams(docs: DataFrame) -> DataFrame:
    """lexical.grams(), in the order of grams within a run."""
    ship_code(docs.sparkSession)
    lower = [F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "description")]
    return docs.select("rowid", *lower).withColumn("size", F.char_length("name") + F.char_length("description")).mapInArrow(_grams, GRAMS)


def counts(tokens: DataFrame, *columns: str) -> DataFrame:
    """(rowid, col, term, n, first_pos, length) with more columns of each row: how often a term stands in a column, and where first."""
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    passed = ["rowid", "length", *columns]
    rows = _full(tokens).select(*passed, "words").mapInArrow(_counts(passed), ", ".join([*[f"`{c}` {kinds[c]}" for c in passed], COUNTS]))
    return rows.select("rowid", "col", "term", "n", "first_pos", "length", *columns)
