"""Operator 5: BPE encoding and decoding with a queue of merge ranks over a doubly linked list of symbols.

The vocabulary file (JSON, in the layout of the public `tokenizers` library) is a parameter and stays where it is; each
Python worker reads it once. Texts go through: added tokens, normalisation (NFC, white space to one space, lower case),
splitting, byte symbols, merges by rank. Equal words of a worker are encoded once, in caches of bounded size: of what
stands between white space, as it is written, and of the words in it.

The file's parts that are understood: a BPE model without byte fallback, dropout or unknown token; normalisers NFC, white
space to one space, lower case; pre-tokenisers Split by a pattern and ByteLevel without a prefix space; added tokens taken as they
are. Any other is refused when the file is read.

Null texts count as empty: no ids, the hash of no bytes. Rows keep their document id, repeated ids and texts included;
other columns don't matter, whatever their names. An empty table gives an empty result. Texts may have any length: the queue makes
one word of n symbols O(n log n).
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.words import claim
from quern.runtime import ship

#: Words whose ids a worker keeps in each of two generations, and the longest of them in characters.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: What Python's str.split() takes for white space, but the library doesn't.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
#: Unicode's White_Space.
WHITE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: itself where printable, else 256 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """encode() and decode() as the file defines them."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"not a BPE model: {model['type']}")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges: dict[int, dict[int, int]] = {}
        self.made: list[int] = []  # by rank: the id that a merge makes
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault(self.vocab[a], {}).setdefault(self.vocab[b], rank)
            self.made.append(self.vocab[a + b])
        self.rank = [merges.get(i, {}).get for i in range(max(self.vocab.values(), default=-1) + 1)]  # by left id: the rank with a right one, or None
        _check(spec)
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        symbols = byte_symbols()
        self.inner, self.last = [self.vocab.get(c, -1) for c in symbols], [self.vocab.get(c + self.suffix, -1) for c in symbols]
        self.partial = -1 in self.inner + self.last  # bytes without a symbol are left out
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", WHITE) if r"[^\s" in pattern else pattern).findall
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.first = frozenset(x[0] for x in self.added)
        self.known, self.spaced = Known(self), Spaced(self)

    def merged(self, word: str) -> list[int]:
        """Ids of one word: always the lowest rank first, leftmost on ties; entries of changed symbols are skipped."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if self.partial:
            ids = [x for x in ids if x >= 0]
        n, rank_of, made = len(ids), self.rank, self.made
        ranks = [rank_of[a](b) for a, b in zip(ids, ids[1:])]  # of the pair that begins here, as it stands
        queue = [rank * n + i for i, rank in enumerate(ranks) if rank is not None]
        if not queue:
            return ids
        heapify(queue)
        ranks.append(None)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            rank, i = divmod(heappop(queue), n)
            if ranks[i] != rank:
                continue  # stale: one of the two has been merged since
            j = right[i]
            ids[i] = new = made[rank]
            ids[j], ranks[j] = -1, None
            h, right[i] = left[i], (k := right[j])
            if k < n:
                left[k] = i
                ranks[i] = rank = rank_of[new](ids[k])
                if rank is not None:
                    heappush(queue, rank * n + i)
            else:
                ranks[i] = None
            if h >= 0:
                ranks[h] = rank = rank_of[ids[h]](new)
                if rank is not None:
                    heappush(queue, rank * n + h)
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[str | int]:
        """Words of a normalised text, and ids of added tokens between them."""
        parts = self.specials.split(text) if self.specials and any(c in text for c in self.first) else [text]
        out: list[str | int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part])
            elif part:
                out += self.plain(part)
        return out

    def plain(self, text: str) -> list[str]:
        """Words of a text without added tokens, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter alone, with no final form
        return self.words(text.lower())  # white space only separates, so one space or many is all the same

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded string) of each stretch without white space that has ids."""
        if any(c in text for c in self.first) or any(c in text for c in _NO_SPACE):
            found = list(map(self.known.__getitem__, self.split(text)))
        else:
            found = list(map(self.spaced.__getitem__, text.split()))
        return found if all(found) else [x for x in found if x]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([x[0] for x in self.pieces(text)]), "<u4").tolist()

    def decode(self, ids) -> str:
        """The vocabulary's strings, joined as the library does where a file names no decoder: by a space."""
        return " ".join([self.strings[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids as little-endian 32-bit integers, SHA-256 of the decoded text)."""
        ids, strings = zip(*found, strict=True) if (found := self.pieces(text)) else ((), ())
        packed = b"".join(ids)
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(" ".join(strings).encode()).hexdigest()


class Known(dict):
    """Encoded words, made where missing. Two generations: of the older one, only what is asked for again stays."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, word: str | int) -> tuple[bytes, str] | None:
        found = self.older.get(word)
        if found is None:
            ids = [word] if isinstance(word, int) else self.bpe.merged(word)
            found = (struct.pack(f"<{len(ids)}I", *ids), self.bpe.decode(ids)) if ids else ()
        if isinstance(word, int) or len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Spaced(Known):
    """Encoded stretches between white space, as they are written: no word, composition or case goes beyond one."""

    def __missing__(self, text: str) -> tuple[bytes, str] | None:
        found = self.older.get(text)
        if found is None:
            words = [x for x in map(self.bpe.known.__getitem__, self.bpe.plain(text)) if x]
            found = words[0] if len(words) == 1 else (b"".join([x[0] for x in words]), " ".join([x[1] for x in words])) if words else ()
        if len(text) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


def _check(spec: dict) -> None:
    """Refuse a file with parts that aren't understood."""
    model, wrong = spec["model"], []
    wrong += [k for k in ("byte_fallback", "dropout", "unk_token", "continuing_subword_prefix", "ignore_merges") if model.get(k) and not (k == "unk_token" and model["unk_token"] in model["vocab"])]
    flat = lambda x, key: [y for part in x[key] for y in flat(part, key)] if x and key in x else [x] if x else []
    for x in flat(spec.get("normalizer"), "normalizers"):
        if x["type"] not in ("NFC", "Lowercase") and not (x["type"] == "Replace" and x["content"] == " " and x["pattern"] in ({"Regex": r"\s+"}, {"String": " "})):
            wrong.append(f"normalizer {x}")
    for x in flat(spec.get("pre_tokenizer"), "pretokenizers"):
        if not (x["type"] == "Split" and "Regex" in x["pattern"] and x["behavior"] == "Removed" and x["invert"] or x["type"] == "ByteLevel" and not x.get("add_prefix_space")):
            wrong.append(f"pre_tokenizer {x}")
    wrong += [f"added token {x['content']}" for x in spec.get("added_tokens", []) if x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") and (x["content"] != x["content"].lower() or any(c.isspace() for c in x["content"]))]
    if spec.get("decoder"):
        wrong.append("decoder")
    if wrong:
        raise ValueError(f"not understood in the vocabulary file: {wrong}")


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """This worker's tokenizer."""
    claim("bpe", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): real ids and texts, for training or storing."""
    ship(docs.sparkSession)

    def batches(it):
        bpe = loaded(path)
        for b in it:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=[id_column, "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(batches, f"`{id_column}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, with no shuffle."""
    ship(docs.sparkSession)

    def batches(it):
        bpe = loaded(path)
        for b in it:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                found = [bpe.digest(t or "") for t in part.column(1).to_pylist()]
                n, a, d = zip(*found, strict=True)
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
