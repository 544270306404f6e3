"""Operator 3: benchmark items inside documents, by size-partitioned MinHash containment search and an exact check.

Words are runs of letters, digits and other non-ASCII characters, in Unicode's lower case (a character for a character);
shingles are five words. An item is in a document if 80 % or more of its distinct shingles are among the document's; of an item
of one to four words the whole sequence is its only shingle, which a document holds if the words stand in it in a row.

Items are partitioned by the size of their sets, in powers of two. For each partition, documents are searched in windows
of twice its upper bound of shingles, half overlapping, so that an item lies whole in one of them, and containment of
0.8 means a similarity of 0.19 or more; an item and a window are a candidate if any of MINIMA minima agree (missed with a
probability below 2e-6 at worst). Windows without a shingle that is an item's minimum can't agree and are skipped. Every
candidate is verified by its exact containment in the whole document.

Items are the query side: they go to the tasks in blocks of at most BLOCK_BYTES of text, one scan a block and one block at a
time; documents stay where they are, and no shuffle is needed.

Null texts and texts without words have no shingles and match nothing. Items or documents that share an id or
a text are matched each on their own and reported once per pair of ids. Empty tables give empty results, or all documents back.
Extra columns are kept by cleaned(), whatever their names. Texts may have any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.llm.words import Words, mix, runs, text_chunks
from quern.runtime import drop, ship, written

SHINGLE, LEAST_PERCENT, MINIMA = 5, 80, 64
#: Text of benchmark items that is sent to the tasks at once.
BLOCK_BYTES = 32 << 20

#: ASCII characters but letters and digits separate words.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_random = np.random.default_rng(3)
_A = (_random.integers(0, 1 << 32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _random.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None]


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.dictionary_decode() if pa.types.is_dictionary(texts.type) else texts)


def shingled(text: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, in order, and each document's first, of texts in lower case."""
    return _shingled(Words(text, offsets, MARKS), size)


def _shingled(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    at, h = runs(words.hashes(), words.first, size)
    return h, np.searchsorted(at, words.first)


def _minima(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MINIMA least values, and the hashes that have them."""
    v = _A * (h >> np.uint64(32)).astype(np.uint32)[None, :] + _B
    at = v.argmin(axis=1)
    return v[np.arange(MINIMA), at], h[at]


class Index:
    """Items by size class: signatures, the hashes that can be minima, exact sets."""

    def __init__(self, ids: list, texts: pa.Array):
        self.sets, self.ids = [], []
        by_set: dict[bytes, int] = {}
        #: Items of fewer words than a shingle: by number of words, their hashes and their ids.
        self.short: dict[int, dict[int, list]] = {}
        for _, text, offsets in text_chunks([pa.record_batch([lowered(texts)], names=["text"])]):
            words = Words(text, offsets, MARKS)
            h, first = _shingled(words, SHINGLE)
            for k in range(len(first) - 1):
                s = np.unique(h[first[k] : first[k + 1]])
                item, n = ids[len(self.ids)], int(words.counts[k])
                self.ids.append((by_set.setdefault(s.tobytes(), len(by_set)), item, len(s)))
                if 0 < n < SHINGLE:
                    one, at = _shingled(words, n)
                    self.short.setdefault(n, {}).setdefault(int(one[at[k]]), []).append(item)
        self.short_hashes = {n: np.array(sorted(x), np.uint64) for n, x in self.short.items()}
        self.items: dict[int, list] = {}
        for no, item, n in self.ids:
            if n:
                self.items.setdefault(no, []).append(item)
        self.sets = {no: np.frombuffer(b, np.uint64) for b, no in by_set.items() if b}
        self.classes: dict[int, dict[tuple[int, int], list[int]]] = {}
        least = []
        for no, s in self.sets.items():
            values, hashes = _minima(s)
            table = self.classes.setdefault(1 << (len(s) - 1).bit_length(), {})
            for k, v in enumerate(values.tolist()):
                table.setdefault((k, v), []).append(no)
            least.append(hashes)
        self.least = np.unique(np.concatenate(least)) if least else np.zeros(0, np.uint64)
        self.bits = max(16, (256 * len(self.least)).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.least >> np.uint64(64 - self.bits)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of shingles that are an item's minimum."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - self.bits)])
        found = np.searchsorted(self.least, h[at])
        return at[self.least[np.minimum(found, len(self.least) - 1)] == h[at]] if len(at) else at

    def candidates(self, h: np.ndarray, hits: np.ndarray) -> set[int]:
        """Item sets that agree in a minimum with a window of the document that holds the hits."""
        out: set[int] = set()
        for upper, table in self.classes.items():
            seen = np.unique(np.concatenate([hits // upper, np.maximum(hits // upper - 1, 0)]))
            for w in seen.tolist():
                values, _ = _minima(h[w * upper : (w + 2) * upper])
                for key in enumerate(values.tolist()):
                    out.update(table.get(key, ()))
        return out

    def matches(self, h: np.ndarray, hits: np.ndarray, percent: int):
        """(item id, shared shingles, the item's shingles) contained in a document."""
        found = self.candidates(h, hits)
        if found:
            whole = np.unique(h)
            for no in sorted(found):
                s = self.sets[no]
                shared = int(np.isin(s, whole, assume_unique=True).sum())
                if 100 * shared >= percent * len(s):
                    for item in self.items[no]:
                        yield item, shared, len(s)

    def found(self, text: np.ndarray, offsets: np.ndarray, percent: int):
        """(document's number, item id, shared shingles, the item's shingles) of texts in lower case."""
        words = Words(text, offsets, MARKS)
        h, first = _shingled(words, SHINGLE)
        hits = self.hits(h)
        of = np.searchsorted(first, hits, "right") - 1
        for d in np.unique(of).tolist():
            for m in self.matches(h[first[d] : first[d + 1]], hits[of == d] - first[d], percent):
                yield d, *m
        for n, known in self.short_hashes.items():
            h, first = _shingled(words, n)
            at = np.flatnonzero(np.isin(h, known))
            for d, x in sorted(set(zip((np.searchsorted(first, at, "right") - 1).tolist(), h[at].tolist(), strict=True))):
                for item in self.short[n][x]:
                    yield d, item, 1, 1


def _lower_chunks(ids: pa.Array, texts: pa.Array):
    return text_chunks([pa.record_batch([ids, lowered(texts)], names=["id", "text"])])


def _searched(sent, percent: int):
    def batches(it):
        for b in it:
            for part, text, offsets in _lower_chunks(b.column(0), b.column(1)):
                ids = part.column(0)
                rows = [(ids[d].as_py(), *m) for d, *m in sent.value.found(text, offsets, percent)]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "n_shared", "n_item"])

    return batches


def _blocks(items: DataFrame, block_bytes: int):
    """Indexes of the items, of bounded size each, sent to the tasks."""
    items = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        yield k == blocks - 1, items.sparkSession.sparkContext.broadcast(Index(block.column(0).to_pylist(), block.column(1).combine_chunks()))


def cleaned(docs: DataFrame, items: DataFrame, percent: int = LEAST_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, with all their columns; no shuffle of texts. What one block leaves is written for the next."""
    ship(docs.sparkSession)
    before = None
    for last, sent in _blocks(items, block_bytes):
        docs = docs.where(arrow_udf(_clean(sent, percent), "boolean")("text"))
        if not last:
            docs = written(docs, "clean")
            sent.destroy()
            drop(*([] if before is None else [before]))
            before = docs
    return docs


def _clean(sent, percent: int):
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for part, text, offsets in _lower_chunks(pa.nulls(len(texts), pa.int8()), texts):
            ok = np.ones(len(part), bool)
            for d, *_ in sent.value.found(text, offsets, percent):
                ok[d] = False
            out.append(pa.array(ok))
        return pa.concat_arrays(out) if out else pa.array([], pa.bool_())

    return clean


def contaminated(docs: DataFrame, items: DataFrame, percent: int = LEAST_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items found in documents."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for last, sent in _blocks(items, block_bytes):
        found = docs.mapInArrow(_searched(sent, percent), "doc_id long, item_id long, n_shared long, n_item long")
        if not last:
            found = written(found, "found")
            sent.destroy()
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


#: Words, shingles and exact containment in SQL, for tables named documents and benchmark.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+') AS w FROM benchmark),
five AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
few AS (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT * FROM five UNION SELECT doc_id, list_slice(w, i, i + n - 1) FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, few)),
bs AS (SELECT DISTINCT item_id, list_slice(w, i, i + 4) AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""
