"""Operator 2: removal of repeated word windows (substring dedup) with a count-min prefilter.

A window is `size` consecutive words of one document; a word goes if a window that covers it also starts earlier
(smaller doc_id, or earlier in the same document), judged on the input.

1. Each task of a scan counts its windows in a count-min sketch of two rows, kept sparse; tasks' sketches are merged
   block by block. Cells count to two, which is all that "repeated" needs. A sketch never underestimates.
2. A second scan drops windows whose estimate is one. The rest are pre-aggregated in the task (a key's first start stays,
   later ones are repeats for sure) and grouped by a 128-bit fingerprint of the words, so that even a window of a third
   of all documents brings a task's number of rows at most. Every row but a group's first start is a repeat.
3. Repeats are gathered by document and cut from its words.

The merged sketch that is broadcast has 2 x 2**bits bits; bits follows from the bytes of text, up to MOST_BITS. Past that
the estimates get loose and more windows go through the exact grouping; the result is the same.

Null texts have no words. Documents without an id take no part and are returned whole; rows that share an id count as one
document, whose starts are told apart by position only, so equal rows don't remove each other. Shorter documents than a
window keep all words. Documents may have any length; other columns don't matter, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.words import Words, mix, runs, text_chunks
from quern.runtime import drop_path, new_path, ship, write, written

SIZE = 20
#: Cells of a sketch row: four for each word that the text may have, between these powers of two.
LEAST_BITS, MOST_BITS, BLOCK_BITS = 20, 29, 20
#: Windows that a task holds before it hands its sketch or its candidates on.
HELD = 4_000_000
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def sketch_bits(n_bytes: int) -> int:
    """Width of a row, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, (4 * n_bytes // 6).bit_length()))


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in each of the two rows."""
    shift = np.uint64(64 - bits)
    return (h >> shift).astype(np.uint32), ((h * _SECOND ^ (h << np.uint64(32))) * _SECOND >> shift).astype(np.uint32)


def _windows(text, offsets, size: int):
    """(Words, index of first word, first hash) of every window."""
    words = Words(text, offsets)
    hashes = words.hashes()
    return words, hashes, *runs(hashes, words.first, size)


def _sketches(size: int, bits: int):
    """A task's sparse sketch: (row * blocks + block, offsets as two planes of bytes, whether a cell counts two)."""

    def emit(held: list[np.ndarray]):
        h = np.concatenate(held)
        blocks = 1 << (bits - BLOCK_BITS)
        for row, cells in enumerate(_cells(h, bits)):
            cells.sort()
            first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            twice = np.diff(np.append(first, len(cells))) > 1
            cells = cells[first]
            edges = np.searchsorted(cells, np.arange(blocks + 1, dtype=np.uint64) << np.uint64(BLOCK_BITS))
            used = np.flatnonzero(np.diff(edges))
            gaps = np.diff(cells, prepend=np.uint32(0))
            gaps[edges[used]] = cells[edges[used]] & np.uint32((1 << BLOCK_BITS) - 1)
            parts = [(row * blocks + k, *(((gaps[a:b] >> np.uint32(s)) & np.uint32(255)).astype(np.uint8).tobytes() for s in (0, 8, 16)), np.packbits(twice[a:b]).tobytes()) for k in used.tolist() for a, b in [(edges[k], edges[k + 1])]]
            for at in range(0, len(parts), 64):
                cols = list(zip(*parts[at : at + 64], strict=True))
                yield pa.record_batch([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["block", "low", "mid", "high", "twice"])

    def batches(it):
        held, n = [], 0
        for _, text, offsets in text_chunks(it):
            *_, h = _windows(text, offsets, size)
            held.append(h)
            n += len(h)
            if n >= HELD:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return batches


def _merged(it):
    """Sorted rows of blocks to one bitmap a block: cells that count two or more."""
    block, once, more = None, None, None

    def out():
        return pa.record_batch([pa.array([block], pa.int32()), pa.array([np.packbits(more).tobytes()], pa.binary())], names=["block", "repeated"])

    for batch in it:
        for k, *planes, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != block:
                if block is not None:
                    yield out()
                block, once, more = k, np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
            gaps = sum(np.frombuffer(p, np.uint8).astype(np.uint32) << np.uint32(8 * s) for s, p in enumerate(planes))
            at = np.cumsum(gaps)
            more[at] |= once[at] | np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at)).astype(bool)
            once[at] = True
    if block is not None:
        yield out()


def _candidates(size: int, bits: int, sketch):
    """Windows estimated repeated, by key: the first start in the task, and the rest as runs of sure repeats."""
    names = ["sure", "h1", "h2", "doc_id", "start", "n"]

    def emit(held):
        h1, h2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, doc, h2, h1))
        h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
        same = np.zeros(len(h1), bool)
        same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h1))))
        later = same & ((doc != doc[lead]) | (start != start[lead]))
        first = ~same
        n = int(first.sum())
        yield pa.record_batch([pa.array(np.zeros(n, bool)), pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64)), pa.array(doc[first]), pa.array(start[first].astype(np.int32)), pa.array(np.ones(n, np.int32))], names=names)
        if later.any():
            doc, start = doc[later], start[later]
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))))
            length = np.append(start[edge[1:] - 1], start[-1]) - start[edge] + 1
            yield pa.record_batch([pa.array(np.ones(len(edge), bool)), pa.array(doc[edge]), pa.array(start[edge]), pa.array(doc[edge]), pa.array(start[edge].astype(np.int32)), pa.array(length.astype(np.int32))], names=names)

    def batches(it):
        rows = sketch.value
        held, n = [], 0
        for part, text, offsets in text_chunks(it):
            words, hashes, at, h = _windows(text, offsets, size)
            likely = np.ones(len(h), bool)
            for row, cells in zip(rows, _cells(h, bits), strict=True):
                likely &= (row[cells >> np.uint32(3)] >> (np.uint32(7) - (cells & np.uint32(7))).astype(np.uint8) & np.uint8(1)).astype(bool)
            if not likely.any():
                continue
            _, h2 = runs(mix(hashes ^ _SECOND), words.first, size, 1)
            at = at[likely]
            doc = words.doc[at]
            held.append((h[likely], h2[likely], part.column(0).to_numpy().astype(np.int64)[doc], at - words.first[doc]))
            n += len(at)
            if n >= HELD // 2:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return batches


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, spans array<struct<start, n>>): n windows in a row, from word `start` on, that also start earlier."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = sketch_bits(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = 1 << (bits - BLOCK_BITS)
    merged = (
        known.mapInArrow(_sketches(size, bits), "block int, low binary, mid binary, high binary, twice binary")
        .repartition("block").sortWithinPartitions("block")
        .mapInArrow(_merged, "block int, repeated binary")
    )
    write(merged, path := new_path(spark, "sketch"))
    rows = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(2)]
    step = 1 << (BLOCK_BITS - 3)
    for x in spark.read.schema(merged.schema).parquet(path).toLocalIterator():  # at most 2 x 2**MOST_BITS bits
        row, block = divmod(x.block, blocks)
        rows[row][block * step : (block + 1) * step] = np.frombuffer(x.repeated, np.uint8)
    drop_path(spark, path)
    sketch = spark.sparkContext.broadcast(rows)
    found = known.mapInArrow(_candidates(size, bits, sketch), "sure boolean, h1 long, h2 long, doc_id long, start int, n int")
    by = Window.partitionBy("h1", "h2", "sure").orderBy("doc_id", "start")
    later = found.withColumn("rank", F.rank().over(by)).where("sure or rank > 1")
    return written(later.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "repeats")


def dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document's words less the repeated ones, joined by one space."""
    spans = repeated_windows(docs, size)

    def batches(it):
        for b in it:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                n_words, n_removed, kept = [], [], []
                for text, found in zip(part.column(1).cast(pa.large_binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or b"").split()
                    gone = 0
                    n_words.append(len(words))
                    if found:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, [x["start"] for x in found], 1)
                        np.add.at(edge, [x["start"] + x["n"] - 1 + size for x in found], -1)
                        keep = np.cumsum(edge)[:-1] == 0
                        words = list(compress(words, keep.tolist()))
                        gone = n_words[-1] - len(words)
                    n_removed.append(gone)
                    kept.append(b" ".join(words).decode())
                yield pa.record_batch([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return left.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(batches, "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return dedup(docs, size).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
