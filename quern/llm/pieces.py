"""Operator 11: piece encoding and decoding with a table of distinct chunks.

The model file (of the public `sentencepiece` library) is a parameter and stays where it is. No piece of it holds a white-space
marker behind another character, so no piece crosses the begin of a marked word: a text is a row of chunks, each some markers and what
follows up to the next marker, and the ids of a text are its chunks' ids in a row.

1. Chunks of all texts are counted: distinct ones of an Arrow batch first, then of a task, then over a shuffle of these counts.
2. Each chunk that stands at least twice is segmented once, into a written table of ids and decoded strings.
3. The table meets the texts again: a batch's chunks are numbered (dictionary encoding), the distinct ones looked up, and ids and
   strings laid out by position. Nothing of the texts is shuffled.

The table goes to all workers, so it's bounded: TABLE_BYTES of chunks, the most frequent first; the bound is kept by counting bytes by
powers of two of the count. Chunks beyond it, and those that stand once, are segmented where they stand, by the same function.

Merges are taken from a queue, the highest score first and leftmost on ties, entries of changed symbols skipped. Characters that the
vocabulary lacks become bytes. Files that normalise, or that have pieces of other kinds (user-defined, unused) or ones that cross
markers, are refused when read.

Null texts count as empty: the end id alone, and the hash of no bytes. Rows keep their id, repeated ids and texts included; other
columns don't matter, whatever their names. An empty table gives an empty result. Texts may have any length: n characters without a
space take O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import buffers, claim
from quern.runtime import ship, written

#: Bytes of distinct chunks, with ROW_BYTES for what belongs to each, that go to every worker.
TABLE_BYTES, ROW_BYTES = 24 << 20, 32
#: Text bytes laid out at once; one longer text goes alone.
SLICE_BYTES = 1 << 21
# The marker of white space, the kinds of pieces in the file.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message: whole numbers, 32-bit and 64-bit values as bytes, strings as bytes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else number()
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """segment() and joined() as the file defines them."""

    def __init__(self, path: str):
        self.strings: list[bytes] = []
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes, self.silent, self.end, wrong, normaliser = {}, set(), None, [], {}
        for field, value in fields(open(path, "rb").read()):
            if field == 1:
                piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(fields(value))
                text, i = piece[1].decode(), len(self.strings)
                self.strings.append(text.replace(MARK, " ").encode())
                if piece[3] == NORMAL:
                    self.scores[text] = (-struct.unpack("<f", piece[2])[0], i)
                    wrong += [text] * (MARK in text.lstrip(MARK))
                elif piece[3] == BYTE:
                    self.bytes[int(text[3:-1], 16)] = i
                    self.strings[i] = bytes([int(text[3:-1], 16)])
                elif piece[3] in (UNKNOWN, CONTROL):
                    self.silent.add(i)
                    self.end = i if text == "</s>" else self.end
                else:
                    wrong.append(f"{text} (kind {piece[3]})")
            elif field == 2:
                wrong += [f"model of kind {v}" for k, v in fields(value) if k == 3 and v != 2]
            elif field == 3:
                normaliser = dict(fields(value))
        # rules, a marker before the text, repeated white space kept, white space to markers
        if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            wrong.append("normaliser")
        if len(self.bytes) != 256:
            wrong.append("no byte pieces")
        if wrong or self.end is None:
            raise ValueError(f"not understood in the model file: {wrong or 'no end id'}")

    def segment(self, chunk: bytes) -> list[int]:
        """Ids of one chunk."""
        symbols: list[str] = list(chunk.decode().replace(" ", MARK))
        n, scores = len(symbols), self.scores
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, 2) for i in range(n - 1) if (m := scores.get(symbols[i] + symbols[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = right[i]
            if not symbols[i] or j < 0 or len(symbols[i]) + len(symbols[j]) != size:
                continue  # stale: one of the two has been merged since
            symbols[i] += symbols[j]
            symbols[j] = ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (m := scores.get(symbols[k] + symbols[right[k]])):
                    heapq.heappush(queue, (m[0], k, len(symbols[k]) + len(symbols[right[k]])))
        out: list[int] = []
        for s in filter(None, symbols):
            found = scores.get(s)
            out += [found[1]] if found else [self.bytes[b] for b in s.encode()]
        return out

    def joined(self, ids) -> bytes:
        """The strings of ids in a row, markers as spaces; bytes that are no UTF-8 become the replacement character."""
        return b"".join([self.strings[i] for i in ids if i not in self.silent]).decode(errors="replace").encode()

    def decode(self, ids) -> str:
        """The text of ids: without the marker that was put before it."""
        return self.joined(ids).decode().removeprefix(" ")


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """This worker's model."""
    claim("pieces", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def chunked(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of texts (binary, in a row) and the number of the first one of each text, and of the end.

    Markers in a text are the same as spaces, and one stands before every text that isn't empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    marked = pc.replace_substring(column, MARK, " ")
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    marked = pc.if_else(pc.equal(marked, none), marked, pc.binary_join_element_wise(space, marked, none))
    text, offsets = buffers(marked)
    blank = text == 0x20
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    at = np.append(starts, len(text)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(text)]), np.searchsorted(starts, offsets)


def slices(batch: pa.RecordBatch, column: int = 1):
    """Parts of a batch of about SLICE_BYTES of text."""
    at, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    while at < len(batch):
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def counted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(chunk binary, n): how often each distinct chunk stands in all texts."""

    def batches(it):
        for b in it:
            for part in slices(b, 0):
                found = pc.value_counts(chunked(part.column(0))[0])
                yield pa.record_batch([found.field(0).cast(pa.binary()), found.field(1)], names=["chunk", "n"])

    return docs.select(text_column).mapInArrow(batches, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def segmented(chunks: DataFrame, path: str) -> DataFrame:
    """(chunk, ids array<int>, decoded binary) of distinct chunks, each segmented once."""

    def batches(it):
        model = loaded(path)
        for b in it:
            ids = [model.segment(c) for c in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([model.joined(x) for x in ids], pa.binary())], names=["chunk", "ids", "decoded"])

    return chunks.select("chunk").mapInArrow(batches, "chunk binary, ids array<int>, decoded binary")


def table(docs: DataFrame, path: str, text_column: str = "text", most: int = TABLE_BYTES) -> DataFrame:
    """The segmented table of the chunks that stand twice or more, at most `most` bytes of it, the most frequent first."""
    ship(docs.sparkSession)
    seen = written(counted(docs, text_column).where("n > 1"), "chunks")
    power = F.floor(F.log2("n")).cast("int")
    sizes = seen.groupBy(power.alias("power")).agg(F.sum(F.length("chunk") + ROW_BYTES).alias("bytes")).orderBy(F.desc("power")).collect()  # a row a power
    least, total = 64, 0
    for row in sizes:
        total += row.bytes
        if total > most:
            break
        least = row.power
    return written(segmented(seen.where(power >= least), path), "segmented")


def _spread(spark, rows: DataFrame):
    """A bounded table as a broadcast of one Arrow stream."""
    found, sink = rows.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found.combine_chunks())
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


class Known:
    """The table in a worker, and the lookup of a slice's distinct chunks in it."""

    def __init__(self, stream: bytes, path: str):
        rows = pa.ipc.open_stream(stream).read_all().combine_chunks()
        self.model = loaded(path)
        self.chunks, self.ids, self.decoded = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], t) for c, t in (("chunk", pa.binary()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())))

    def of(self, distinct: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids, decoded) of distinct chunks: looked up, or segmented here."""
        at = pc.index_in(distinct.cast(pa.binary()), value_set=self.chunks)
        new = pc.filter(distinct, pc.is_null(at)).to_pylist()
        ids = [self.model.segment(c) for c in new]
        place = pc.is_null(at).to_numpy(zero_copy_only=False)
        where = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        where[place] = len(self.chunks) + np.arange(len(new))
        where = pa.array(where)
        every = pa.concat_arrays([self.ids.cast(pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))])
        strings = pa.concat_arrays([self.decoded, pa.array([self.model.joined(x) for x in ids], pa.binary())])
        return every.take(where), strings.take(where)


def laid_out(known: Known, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts in a row, offsets by text, decoded bytes, offsets by text), laid out by the positions of chunks."""
    chunks, first = chunked(column)
    coded = chunks.dictionary_encode()
    ids, strings = known.of(coded.dictionary)
    # the ids and strings of every position
    lists = pa.LargeListArray.from_arrays(pa.array(ids.offsets.to_numpy() - ids.offsets[0].as_py(), pa.int64()), ids.flatten()) if len(ids) else pa.array([], pa.large_list(pa.int32()))
    placed, spelled = lists.take(coded.indices), strings.cast(pa.large_binary()).take(coded.indices)
    flat = placed.flatten().to_numpy(zero_copy_only=False) if len(placed) else np.zeros(0, np.int32)
    by_ids = np.concatenate([[0], np.cumsum(pc.list_value_length(placed).to_numpy(zero_copy_only=False))]).astype(np.int64)
    text, by_bytes = buffers_of(spelled)
    return flat, by_ids[first], text, by_bytes[first]


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary column and its offsets."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", most: int = TABLE_BYTES) -> DataFrame:
    """(id, ids array<int> with the end id, decoded string): real ids and texts, for training or storing."""
    spark = docs.sparkSession
    sent = _spread(spark, table(docs, path, text_column, most))
    kind = docs.schema[id_column].dataType.simpleString()

    def batches(it):
        known = Known(sent.value, path)
        for b in it:
            for part in slices(b):
                ids, at, text, at_text = laid_out(known, part.column(1))
                lists = [[*ids[x:y].tolist(), known.model.end] for x, y in zip(at[:-1], at[1:], strict=True)]
                strings = [text[x:y].tobytes().decode().removeprefix(" ") for x, y in zip(at_text[:-1], at_text[1:], strict=True)]
                yield pa.record_batch([part.column(0), pa.array(lists, pa.list_(pa.int32())), pa.array(strings, pa.string())], names=[id_column, "ids", "decoded"])

    return docs.select(id_column, text_column).mapInArrow(batches, f"`{id_column}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, most: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    sent = _spread(docs.sparkSession, table(docs, path, "text", most))

    def batches(it):
        known = Known(sent.value, path)
        decimals = pa.array([f"{i} ".encode() for i in range(len(known.model.strings))], pa.large_binary())
        last = str(known.model.end).encode()
        for b in it:
            for part in slices(b):
                ids, at, text, at_text = laid_out(known, part.column(1))
                spelled, by_id = buffers_of(decimals.take(pa.array(ids, pa.int32())))
                at_id = by_id[at]
                spelled, text = spelled.tobytes(), text.tobytes()
                n, hashed, decoded = [], [], []
                for k in range(len(part)):
                    n.append(int(at[k + 1] - at[k]) + 1)
                    hashed.append(hashlib.sha256(spelled[at_id[k] : at_id[k + 1]] + last).hexdigest())
                    decoded.append(hashlib.sha256(text[at_text[k] + (at_text[k + 1] > at_text[k]) : at_text[k + 1]]).hexdigest())
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hashed), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
