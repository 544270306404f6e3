"""Operator 10: removal of repeated passages of two or more lines (line dedup).

Lines are what newlines separate; empty ones don't count. A hash that rolls over the hashes of WINDOW lines chooses boundaries: one
stands behind a line where the hash is a multiple of DIVISOR, so boundaries depend on the lines before them alone and come back
WINDOW lines behind any insertion. A chunk is what stands between two boundaries, of two lines at least. Chunks that also
stand earlier (smaller doc_id, or earlier in the same document) go, with one newline beside them; the first one stays. Chunks
of equal 128-bit hashes are compared byte by byte.

A common passage seldom begins and ends at boundaries, and one of two lines may hold none. So what these chunks leave is extended
line by line to the full common run: in a second round the chunks are all pairs of neighbouring lines that don't lie in a removed
chunk, found and compared in the same way. (A removed chunk's own pairs stand in its first place.) So every line of every repeated
passage goes, however short the passage and wherever it begins, and the first place of each line stays.

In each round:

1. A scan emits the hash of every chunk, summed up by task and key; keys seen twice are kept.
2. The places of those keys go back to their documents (other documents are left out before the shuffle, by a bitmap of
   fixed size), and come out with the chunk's bytes; a task sends its first place of each chunk, later ones are repeats
   for sure. Rows of one hash and equal bytes are ranked: all but the first are repeats.

At the end repeats are gathered by document and cut from the text; documents that the bitmap rules out aren't shuffled.

Null texts have no lines and stay null. Documents without an id are returned unchanged; rows that share an id are told
apart by position only, so equal rows don't remove each other. An empty table gives an empty result. Extra columns are kept,
whatever their names. Documents may have any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.llm.neardup import only
from quern.llm.words import Words, ranges, runs, text_chunks
from quern.runtime import fresh, ship, written

NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
#: Lines of the least chunk, the least that a passage has.
LINES = 2
#: Lines that the rolling hash covers, and one of how many places it makes a boundary.
WINDOW, DIVISOR = 2, 4
#: Bytes of chunks that a task holds before it hands them on.
HELD = 64 << 20


def chunks_of(text: np.ndarray, offsets: np.ndarray):
    """(document, start byte, end byte, h1, h2) of every two consecutive lines, from left to right."""
    lines = Words(text, offsets, NEWLINE)
    (at, h1), (_, h2) = (runs(lines.hashes(k), lines.first, LINES, k) for k in (0, 1))
    doc = lines.doc[at]
    return doc, lines.starts[at] - offsets[doc], lines.ends[at + LINES - 1] - offsets[doc], h1, h2


def defined_chunks(text: np.ndarray, offsets: np.ndarray):
    """(document, start byte, end byte, h1, h2) of every chunk between boundaries that the rolling hash chooses, of LINES lines at least."""
    lines = Words(text, offsets, NEWLINE)
    hashes = [lines.hashes(k) for k in (0, 1)]
    at, rolling = runs(hashes[0], lines.first, WINDOW)
    begins = np.zeros(len(lines.starts) + 1, bool)
    begins[at[rolling % np.uint64(DIVISOR) == 0] + WINDOW] = True
    begins[lines.first] = True  # documents' first lines, and the end
    edges = np.flatnonzero(begins)
    a, z = edges[:-1], edges[1:]
    a, z = a[z - a >= LINES], z[z - a >= LINES]
    doc = lines.doc[a]
    return doc, lines.starts[a] - offsets[doc], lines.ends[z - 1] - offsets[doc], *[ranges(h, a, z, k) for k, h in enumerate(hashes)]


def inside(doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: list) -> np.ndarray:
    """Which chunks lie in one of their document's spans (which don't overlap)."""
    out = np.zeros(len(doc), bool)
    for d in [k for k, x in enumerate(spans) if x]:
        low, high = np.array(sorted((s["start"], s["end"]) for s in spans[d])).T
        a, z = np.searchsorted(doc, [d, d + 1])
        k = np.searchsorted(low, starts[a:z], "right") - 1
        out[a:z] = (k >= 0) & (ends[a:z] <= high[k])
    return out


def left_pairs(text: np.ndarray, offsets: np.ndarray, spans: list):
    """The pairs of neighbouring lines that lie in none of the spans."""
    found = chunks_of(text, offsets)
    keep = ~inside(*found[:3], spans)
    return tuple(x[keep] for x in found)


def _hashed(it, first_round: bool):
    """(h1, h2, n) by task and key."""

    def emit(held):
        keys = np.concatenate(held)
        keys, n = np.unique(keys, axis=0, return_counts=True)
        return pa.record_batch([pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(n.astype(np.int64))], names=["h1", "h2", "n"])

    held, n = [], 0
    for part, text, offsets in text_chunks(it):
        *_, h1, h2 = defined_chunks(text, offsets) if first_round else left_pairs(text, offsets, part.column(2).to_pylist())
        held.append(np.stack([h1, h2], axis=1))
        n += len(h1)
        if n > 500_000:
            yield emit(held)
            held, n = [], 0
    if n:
        yield emit(held)


def _places(it, first_round: bool):
    """(doc_id, h1, h2) of every chunk."""
    for part, text, offsets in text_chunks(it):
        doc, _, _, h1, h2 = defined_chunks(text, offsets) if first_round else left_pairs(text, offsets, part.column(2).to_pylist())
        if len(doc):
            yield pa.record_batch([pa.array(part.column(0).to_numpy()[doc]), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc_id", "h1", "h2"])


def _cut_out(it, first_round: bool):
    """Documents (doc_id, text, spans, keys) to (h1, h2, chunk, doc_id, start, end, sure) of repeated keys, pre-aggregated by task; in the second
    round with the pairs that lie in the first one's spans."""
    names = ["h1", "h2", "chunk", "doc_id", "start", "end", "sure"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def emit(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    first: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
    held, sure = 0, []
    for part, text, offsets in text_chunks(it):
        ids = part.column(0).to_numpy()
        wanted = [{(k["h1"], k["h2"]) for k in x or []} for x in part.column(3).to_pylist()]
        data = text.tobytes()
        chunks = defined_chunks(text, offsets) if first_round else chunks_of(text, offsets)
        known = inside(*chunks[:3], part.column(2).to_pylist())
        for d, a, b, h1, h2, done in zip(*(x.tolist() for x in (c.view(np.int64) if c.dtype == np.uint64 else c for c in (*chunks, known))), strict=True):
            if done:
                sure.append((h1, h2, None, int(ids[d]), a, b, True))
                if len(sure) >= 20_000:
                    yield emit(sure)
                    sure = []
                continue
            if (h1, h2) not in wanted[d]:
                continue
            at = int(offsets[d])
            key, place = (h1, h2, data[at + a : at + b]), (int(ids[d]), a, b)
            other = first.get(key)
            if other is None:
                first[key] = place
                held += b - a + 200
            elif place[:2] != other[:2]:
                first[key] = min(place, other)
                late = max(place, other)
                sure.append((late[0], late[1], None, *late, True))
                if len(sure) >= 20_000:
                    yield emit(sure)
                    sure = []
        if held >= HELD:
            yield from (emit(rows) for rows in _groups([(*k, *p, False) for k, p in first.items()]))
            first, held = {}, 0
    if sure:
        yield emit(sure)
    yield from (emit(rows) for rows in _groups([(*k, *p, False) for k, p in first.items()]))


def _groups(rows: list, size: int = 2_000):
    return (rows[a : a + size] for a in range(0, len(rows), size))


def _repeats(docs: DataFrame, first_round: bool) -> DataFrame:
    """(doc_id, spans array<struct<start, end>>): bytes of chunks of docs(doc_id, text, spans) that also stand earlier."""
    with_round = lambda f: lambda it: f(it, first_round)
    many = docs.mapInArrow(with_round(_hashed), "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")
    places = docs.mapInArrow(with_round(_places), "doc_id long, h1 long, h2 long").distinct().join(many, ["h1", "h2"])
    of_doc = written(places.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("keys")), "chunk-keys")
    found = only(docs.where("spans is null"), of_doc).join(of_doc.hint("merge"), "doc_id").select("doc_id", "text", "spans", "keys")
    if not first_round:  # what has spans comes along in any case
        found = found.unionByName(docs.where("spans is not null").join(of_doc.hint("merge"), "doc_id", "left").select("doc_id", "text", "spans", "keys"))
    found = found.mapInArrow(with_round(_cut_out), "h1 long, h2 long, chunk binary, doc_id long, start long, end long, sure boolean")
    # repeats for sure need no rank; they are dealt by document, so that a common chunk doesn't gather in one task
    by = Window.partitionBy("h1", "h2", "chunk", F.when(F.col("sure"), F.col("doc_id"))).orderBy("doc_id", "start")
    later = found.withColumn("rank", F.rank().over(by)).where("sure or rank > 1")
    return written(later.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "chunk-repeats")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start, end>>): bytes of pairs of lines that also stand earlier."""
    ship(docs.sparkSession)
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    none = F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans")
    chunks = _repeats(known.select("*", none), True)
    touched = written(only(known, chunks).join(chunks.hint("merge"), "doc_id", "left").select("doc_id", "text", "spans"), "chunk-texts")
    return _repeats(only(known, chunks, False).select("*", none).unionByName(touched), False)


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the spans' bytes."""
    out = []
    for text, found in zip(texts.cast(pa.large_binary()).to_pylist(), spans.to_pylist(), strict=True):
        kept, at = [], 0
        for s in sorted(found or [], key=lambda s: s["start"]):
            a, z = s["start"], s["end"]
            if text[z : z + 1] == b"\n":
                z += 1
            elif a > at and text[a - 1 : a] == b"\n":
                a -= 1
            kept.append(text[at:a])
            at = z
        out.append(None if text is None else b"".join([*kept, text[at:]]).decode())
    return pa.array(out, pa.string())


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and other columns) with repeated chunks cut from text, and the number of cuts in _removed (longer by
    underscores where the table has that name)."""
    at, found = fresh(docs, "_at"), fresh(docs, "_spans")
    spans = repeated_chunks(docs)
    touched = only(docs, spans).join(spans.select(F.col("doc_id").alias(at), F.col("spans").alias(found)).hint("merge"), F.col("doc_id").cast("long") == F.col(at), "left")
    cut = F.col(found).isNotNull()
    text = F.when(cut, arrow_udf(_cut, "string")(F.when(cut, F.col("text")), found)).otherwise(F.col("text"))
    removed = fresh(docs, "_removed")
    columns = [f"`{c}`" for c in docs.columns if c != "text"]
    touched = touched.select(*columns, text.alias("text"), F.coalesce(F.size(found), F.lit(0)).cast("long").alias(removed))
    whole = only(docs, spans, False).select(*columns, "text", F.lit(0).cast("long").alias(removed))
    return whole.unionByName(touched).select([f"`{c}`" for c in (*docs.columns, removed)])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_removed, n_chars, kept_sha256): cuts, length and hash of what stays; a null text hashes as empty."""
    kept = dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return kept.select("doc_id", F.col("_removed").alias("n_removed"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
