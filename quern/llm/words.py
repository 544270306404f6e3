"""Vectorised words, hashes and shingles over Arrow string columns (numpy on the UTF-8 bytes, no loop over words)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes \x20 and \x09-\x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes handled at once, so that temporary arrays stay small; one longer document goes alone.
CHUNK_BYTES = 1 << 18

#: The operator whose caches this worker holds, and what drops them.
_holder: list = ["", None]


def claim(name: str, drop: Callable[[], None] | None = None) -> None:
    """Before work of another kind in a worker that is used again: drop the last kind's caches and return free memory."""
    if _holder[0] != name:
        if _holder[1]:
            _holder[1]()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library
            pa.default_memory_pool().release_unused()
        _holder[:] = [name, drop]


_random = np.random.default_rng(20240501)
_TABLES = _random.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03]
_WORD_BASES = [0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        up, down = (np.full(size, b, np.uint64) for b in (base, inverse))
        up[0] = down[0] = 1
        have = _powers[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size > 1 << 19:  # of a very long text; not kept
            _powers.pop(base)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (from 0); a null is an empty text."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if column.type == pa.large_string() else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return text, offsets - offsets[0]


def chunks(text: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


class Words:
    """The words of some documents. starts, ends: in bytes; doc: index of each word's document; first: index of each document's first word."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.text, self.offsets = text, offsets
        inside = ~separators[text]
        edge = np.zeros(len(text) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(text), bool)
        if len(text):
            before[0], before[1:] = False, inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(text), bool)
        if len(text):
            after[-1], after[:-1] = False, inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the two functions are independent."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = powers(_BASES[which], len(self.text))
        total = np.zeros(len(self.text) + 1, np.uint64)
        np.cumsum(_TABLES[which][self.text] * up[: len(self.text)], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def runs(word_hashes: np.ndarray, first: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of its first word, hash) of every run of `size` consecutive words of one document."""
    n = len(word_hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(_WORD_BASES[which], n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes * up[:n], out=total[1:])
    h = (total[size:] - total[:-size]) * down[: n - size + 1]
    room = np.repeat(first[1:], np.diff(first))[: n - size + 1] - size  # the last start in the word's document
    at = np.flatnonzero(np.arange(n - size + 1) <= room)
    return at, mix(h[at])


def ranges(word_hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the words from each start up to its end, of any number."""
    up, down = powers(_WORD_BASES[which], len(word_hashes))
    total = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * up[: len(word_hashes)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def text_chunks(batches, column: str = "text", holder: str = "words", drop: Callable[[], None] | None = None):
    """(slice of the batch, bytes, offsets) for pieces of bounded size. What `holder` keeps beside, `drop` drops when others work."""
    claim(holder, lambda: (_powers.clear(), drop and drop()))
    for batch in batches:
        text, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        for a, b in chunks(text, offsets):
            yield batch.slice(a, b - a), text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
