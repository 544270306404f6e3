"""Operator 4: a quality classifier by the perplexity of an interpolated modified Kneser-Ney model of characters.

Trusted text: documents whose labels all say quality 1 and toxic 0. All of it is counted, in every language. The units
are characters as they are (every code point is its own symbol, none is folded), in runs of ORDER; what is gathered
grows with the trusted text, without a cap.

1. Tasks count the runs of trusted text by language, of all documents but one in HELD_OUT (by a hash of the id); counts are
   summed by run. From them come models of each language and of all text.
2. Continuation counts, counts of counts, discounts and context totals are joined by run and by context to the
   discounted probability of each seen run and the weight that each context leaves to shorter runs.
3. The counts are dealt to shards of about SHARD_ENTRIES, by the last two characters of the context, so that a character's
   run and all its shorter ones meet in one shard (single characters and pairs stand in each). A shard is packed in one task and
   joined to the documents map-side, shard by shard; a document's parts are summed. Documents aren't shuffled for it.
4. A document's perplexity is exp of the mean negative log-probability of its characters. It is rejected beyond the HIGH
   quantile of its language: of the held-out trusted documents' log-perplexity (nearest ranks), as median plus distance from the median, the
   distance smoothed by that of all languages (SMOOTH_DOCUMENTS).
5. Few words in clean prose don't move a document's mean, so words count by themselves: of every word (open vocabulary, any
   number) the trusted documents and those labelled toxic that hold it are counted in shards. A document is rejected too
   if it holds a word that is LEAST_RATIO times as frequent among toxic documents, at SURE standard errors below the
   estimate; or if more than LIKELY_SHARE of its words are LIKELY_RATIO times as frequent, at LIKELY standard errors below.
   Hashes of those words only are broadcast.

Documents of a language without trusted text on either side, or of none, take the model and quantile of all trusted text.
Null or empty texts have no perplexity and are rejected. Without any trusted text nothing else is rejected. Rows that
share an id are scored each on their own and trusted together; equal rows get equal scores. An empty table gives an empty
result. Extra columns are kept by filtered(), whatever their names. Texts may have any length.
"""

from __future__ import annotations

import pickle
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.llm.neardup import only
from quern.llm.words import LOWER, Words, mix, text_chunks
from quern.runtime import drop, fresh, ship, written

ORDER = 4
#: One in so many trusted documents sets the quantiles; the others are counted.
HELD_OUT = 4
SMOOTH_DOCUMENTS = 100
HIGH = 0.995
#: Quantiles are those of log-perplexities in steps of 1 / STEPS, rounded up; they lie below 21 (-log LEAST), so a language has some 210,000
#: different ones at most, however many documents it has, and whatever the order in which they come.
STEPS = 10_000
LEAST_RATIO, SURE = 5.0, 3.0
#: Weaker signs, which count by their share of a document's words.
LIKELY_RATIO, LIKELY, LIKELY_SHARE = 4.0, 2.0, 0.005
#: Runs and contexts that are sent to the tasks at once, about.
SHARD_ENTRIES = 2_000_000
#: Characters that a task counts at once.
HELD = 2_000_000

#: A chance below it counts as this (contexts that leave nothing to shorter runs).
LEAST = 1e-9
#: The model of all text; a language's own is "=" and its name.
EVERY = "*"
#: What stands between words: ASCII other than letters and digits.
APART = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])
_PAD = ord(" ")
#: Weights of the characters of a run in its key, from the last one back.
_WEIGHTS = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(ORDER)]


#: This worker's shard, by name: the last one used.
_opened: dict[str, Shard] = {}


def _chunks(batches):
    return text_chunks(batches, holder="quality", drop=_opened.clear)


def padded(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of some documents, ORDER - 1 spaces before each; where each character stands; each document's number."""
    pad = ORDER - 1
    points = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
    counts = np.diff(before[offsets])
    place = np.arange(len(points)) + pad * (1 + np.repeat(np.arange(len(counts)), counts))
    symbols = np.full(len(points) + pad * len(counts), _PAD, np.uint32)
    symbols[place] = points
    return symbols, place, counts


def keys_of(symbols: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Keys of the runs of 1 to ORDER characters that end at each place."""
    wide, total, out = symbols.astype(np.uint64) + np.uint64(1), np.zeros(len(place), np.uint64), []
    for k in range(ORDER):
        total = total + wide[place - k] * _WEIGHTS[k]
        out.append(total)
    return out


def _counted(it):
    """(lang, gram, n) of a task's trusted text; a null language stays null."""
    held: dict[str | None, list] = {}
    size = 0

    def emit():
        for lang, runs in held.items():
            every = np.concatenate(runs)
            _, at, n = np.unique(keys_of(every.reshape(-1), np.arange(len(every)) * ORDER + ORDER - 1)[-1], return_index=True, return_counts=True)
            joined = every[at].tobytes().decode("utf-32-le")
            grams = [joined[k : k + ORDER] for k in range(0, len(joined), ORDER)]
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    for part, text, offsets in _chunks(it):
        symbols, place, counts = padded(text, offsets)
        runs = np.lib.stride_tricks.sliding_window_view(symbols, ORDER)[place - ORDER + 1] if len(place) else np.zeros((0, ORDER), np.uint32)
        edges, langs = np.concatenate(([0], np.cumsum(counts))), part.column(0).to_pylist()
        for lang in set(langs):
            held.setdefault(lang, []).append(np.concatenate([runs[edges[k] : edges[k + 1]] for k, x in enumerate(langs) if x == lang]))
        size += len(place)
        if size >= HELD:
            yield from emit()
            held, size = {}, 0
    yield from emit()


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that all their labels trust."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(1))).alias("t"))
    return good.where("q = 1 and t = 0").select("doc_id")


def _worded(it):
    """(word, toxic, n): in how many documents of a task each word's hash stands, by label."""

    def emit():
        for toxic, hashes in held.items():
            if hashes:
                words, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(np.full(len(words), toxic)), pa.array(n.astype(np.int64))], names=["word", "toxic", "n"])

    held, size = {True: [], False: []}, 0
    for part, text, offsets in _chunks(it):
        words = Words(LOWER[text], offsets, APART)
        h = words.hashes()
        _, once = np.unique(h ^ mix(words.doc.astype(np.uint64) + np.uint64(1)), return_index=True)  # each word of a document
        toxic = part.column(0).to_numpy(zero_copy_only=False)[words.doc[once]]
        for kind, hashes in held.items():
            hashes.append(h[once[toxic == kind]])
        size += len(once)
        if size >= HELD // 4:
            yield from emit()
            held, size = {True: [], False: []}, 0
    yield from emit()


def toxic_words(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that stand for toxic documents, and which of them do so by themselves."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"))
    sides = written(known.where("t = 1").select("doc_id", F.lit(True).alias("toxic")).union(trusted_ids(labels).select("doc_id", F.lit(False))), "sides")
    text = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = only(text, sides.select("doc_id")).join(sides, "doc_id").select("toxic", "text")
    many = {x.toxic: x.n for x in text.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(many) < 2:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    counts = text.mapInArrow(_worded, "word long, toxic boolean, n long").groupBy("word").agg(*[F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(k) for k, x in (("t", F.col("toxic")), ("c", ~F.col("toxic")))])
    ratio = F.log((F.col("t") + 0.5) / (many[True] + 1)) - F.log((F.col("c") + 0.5) / (many[False] + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    sure, likely = (ratio - errors * error >= float(np.log(least)) for errors, least in ((SURE, LEAST_RATIO), (LIKELY, LIKELY_RATIO)))
    found = counts.where("t > 0").where(sure | likely).select("word", sure.alias("sure")).toArrow()
    words, alone = (found.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(words)
    return words[order], alone[order]


def counted_models(text: DataFrame) -> DataFrame:
    """(model, gram, n) of rows (lang, text): each language's and all text's."""
    grams = written(text.select("lang", "text").mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    own = grams.where("lang is not null").select(F.concat(F.lit("="), "lang").alias("model"), "gram", "n")
    return own.union(grams.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(EVERY), "gram", "n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Of counts (model, gram, n) of runs of ORDER: (model, size, gram, p, weight). Rows with p hold the discounted probability of a
    seen run; rows with weight the share that a context of size - 1 characters leaves to shorter runs."""
    sizes = [counts.select("model", F.lit(ORDER).alias("size"), "gram", "n")]
    for k in range(ORDER - 1, 0, -1):  # shorter runs count the different characters before them
        sizes.append(sizes[-1].groupBy("model", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")).select("model", F.lit(k).alias("size"), "gram", "n"))
    every = sizes[0]
    for x in sizes[1:]:
        every = every.union(x)
    every = written(every.withColumn("context", F.expr("substring(gram, 1, size - 1)")), "runs")
    of = every.groupBy("model", "size").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.expr("coalesce(try_divide(n1, n1 + 2 * n2), 0)")
    discount = of.select(
        "model", "size",
        *[F.when(F.col(f"n{k}") > 0, F.greatest(F.lit(0.0), F.try_divide(k * F.col(f"n{k}") - (k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}")))).otherwise(0.5 * k).alias(f"d{k}") for k in (1, 2, 3)],
    )
    context = every.groupBy("model", "size", "context").agg(F.sum("n").alias("total"), *[F.sum(x.cast("double")).alias(f"k{k}") for k, x in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") >= 3))])
    context = context.join(discount, ["model", "size"]).withColumn("weight", F.expr("(d1 * k1 + d2 * k2 + d3 * k3) / total"))
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    seen = every.join(context, ["model", "size", "context"]).select("model", "size", "gram", ((F.col("n") - less) / F.col("total")).alias("p"), F.lit(None).cast("double").alias("weight"))
    return seen.union(context.select("model", "size", F.col("context").alias("gram"), F.lit(None).cast("double"), "weight"))


class Shard:
    """Runs and contexts of some models: log P of seen runs, log of the contexts' weights, by 64-bit key."""

    def __init__(self, model: np.ndarray, size: np.ndarray, grams: list[str], p: np.ndarray, weight: np.ndarray, symbols: np.ndarray):
        length = np.array([len(g) for g in grams])
        points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(length)
        run = np.isfinite(p)
        keys, suffix, context = (np.zeros(len(grams), np.uint64) for _ in range(3))
        for k in range(ORDER):  # from the last character back
            here = length > k
            add = np.zeros(len(grams), np.uint64)
            add[here] = (points[ends[here] - 1 - k].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[k]
            keys += add
            suffix += np.where(length - 1 > k, add, np.uint64(0))
            if k:
                context[here] += (points[ends[here] - 1 - k].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[k - 1]
        self.runs, self.rest = {}, {}
        for k in range(1, ORDER + 1):
            own = ~run & (size == k)
            self.rest[k] = Lookup(salted(keys[own], model[own]), weight[own])
            own = run & (size == k)
            where = model[own]
            below = 1.0 / (symbols[where] + 1) if k == 1 else self.runs[k - 1].get(salted(suffix[own], where), 0.0)
            chance = p[own] + self.rest[k].get(salted(context[own], where), 1.0) * below
            self.runs[k] = Lookup(salted(keys[own], where), chance)
        for part in (*self.runs.values(), *self.rest.values()):
            part.values = np.log(np.maximum(part.values, LEAST)).astype(np.float32)
        self.unseen = -np.log(symbols + 1.0)

    def costs(self, keys: list[np.ndarray], before: list[np.ndarray], model: int) -> np.ndarray:
        """Negative log-probability of characters: keys of the runs that end with them, and of those that end before them."""
        out, open_ = np.zeros(len(keys[0])), np.arange(len(keys[0]))
        for k in range(ORDER, 0, -1):
            found = self.runs[k].get(salted(keys[k - 1][open_], model), np.nan)
            hit = ~np.isnan(found)
            out[open_[hit]] -= found[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
            context = before[k - 2][open_] if k > 1 else np.zeros(len(open_), np.uint64)
            out[open_] -= self.rest[k].get(salted(context, model), 0.0)
        out[open_] -= self.unseen[model]
        return out


def salted(keys: np.ndarray, model) -> np.ndarray:
    return mix(keys ^ (np.atleast_1d(model).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


class Lookup:
    """Values by 64-bit key: sorted keys, and where those of each leading bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.uint64(0)), np.append(values[order].astype(np.float64), 0)
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        bucket = (keys[order] >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(bucket, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.most = int(np.diff(self.begin).max(initial=0))

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing, self.values.dtype)
        bucket = (keys >> self.shift).astype(np.int64)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        open_ = None
        for _ in range(self.most):
            hit = (self.keys[at] == keys) & (at < end)
            (where := np.flatnonzero(hit)) if open_ is None else (where := open_[hit])
            out[where] = self.values[at[hit]]
            left = np.flatnonzero(~hit & (at + 1 < end))
            if not len(left):
                break
            open_ = left if open_ is None else open_[left]
            keys, at, end = keys[left], at[left] + 1, end[left]
        return out


def shards(models: DataFrame, names: list[str], entries: int) -> tuple[DataFrame, int]:
    """(shard, packed): the entries of kneser_ney() of some models, packed in tasks of bounded size; and the number of shards."""
    number = {x: k for k, x in enumerate(names)}
    mine = models.where(F.col("model").isin(names))
    n = max(1, -(-mine.count() // entries))
    # by the last two characters of the context of a longer run; single characters and pairs stand in every shard
    pair = F.when(F.col("p").isNotNull(), F.expr("substring(gram, size - 2, 2)")).otherwise(F.expr("substring(gram, -2, 2)"))
    by_pair = F.pmod(31 * F.ascii(pair) + F.ascii(F.substring(pair, 2, 1)), F.lit(n)).cast("int")
    dealt = mine.withColumn("shard", F.explode(F.when(F.col("size") > 2, F.array(by_pair)).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))))

    def pack(t: pa.Table) -> pa.Table:
        model = np.array([number[x] for x in t.column("model").to_pylist()])
        size, grams = t.column("size").to_numpy(), t.column("gram").to_pylist()
        p, weight = (t.column(c).to_numpy().astype(np.float64) for c in ("p", "weight"))
        symbols = np.bincount(model[(size == 1) & np.isfinite(p)], minlength=len(names)).astype(np.float64)
        packed = zlib.compress(pickle.dumps(Shard(model, size, grams, p, weight, symbols), protocol=5), 1)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "packed": pa.array([packed], pa.binary())})

    return written(dealt.groupBy("shard").applyInArrow(pack, "shard int, packed binary"), "shards"), n


def _open(sent) -> Shard:
    """This worker's shard: the last one used."""
    name, packed = sent.value
    if name not in _opened:
        _opened.clear()
        _opened[name] = pickle.loads(zlib.decompress(packed))
    return _opened[name]


def _cost(sent, n: int, shard: int, number: dict[str, int], text: str, model: str) -> Column:
    """Sum of the costs of the characters that a shard knows; null without a model."""

    def cost(texts: pa.Array, models: pa.Array) -> pa.Array:
        known = _open(sent)
        which = np.array([number.get(x, -1) for x in models.to_pylist()], np.int64)
        out = np.full(len(texts), np.nan)
        for k in np.unique(which[which >= 0]).tolist():
            rows, at = np.flatnonzero(which == k), 0
            for piece, data, offsets in _chunks([pa.record_batch([texts.take(pa.array(rows))], names=["text"])]):
                symbols, place, counts = padded(data, offsets)
                doc = np.repeat(np.arange(len(counts)), counts)
                if n > 1:
                    mine = (31 * symbols[place - 2].astype(np.int64) + symbols[place - 1]) % n == shard
                    place, doc = place[mine], doc[mine]
                total = np.bincount(doc, known.costs(keys_of(symbols, place), keys_of(symbols, place - 1), k), minlength=len(counts))
                out[rows[at : at + len(piece)]] = total
                at += len(piece)
        return pa.array(out, from_pandas=True)

    return arrow_udf(cost, "double")(F.col(text), F.col(model))


class Scorer:
    """Adds log-perplexities to documents, from the shards of some models."""

    def __init__(self, models: DataFrame, names: list[str]):
        self.number = {x: k for k, x in enumerate(names)}
        self.shards, self.n = shards(models, names, SHARD_ENTRIES)

    def sent(self, shard: int):
        """One shard's entries, about SHARD_ENTRIES, on their way to the tasks."""
        packed = self.shards.where(F.col("shard") == shard).select("packed").toArrow().column(0)
        return self.shards.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, packed[0].as_py() if len(packed) else zlib.compress(pickle.dumps(Shard(*(np.zeros(0) for _ in range(2)), [], *(np.zeros(0) for _ in range(2)), np.zeros(len(self.number)))))))

    def added(self, docs: DataFrame, model: Column, name: str, beside: dict[str, Column] | None = None) -> DataFrame:
        """`docs` with a column: mean negative log-probability of the characters of `text`; null of no text or no model.

        Columns `beside` it are worked out in the same pass, so that a task needs one Python worker."""
        of, total, key = (fresh(docs, x) for x in ("model", "total", "row"))
        beside = beside or {}
        docs = docs.withColumn(of, model)
        n_chars = F.nullif(F.char_length("text"), F.lit(0))
        if self.n == 1:
            out = docs.withColumns({total: _cost(self.sent(0), 1, 0, self.number, "text", of), **beside})
            return out.withColumn(name, F.col(total) / n_chars).drop(of, total)
        row = F.struct(F.col("doc_id"), F.xxhash64("text"), F.col(of))
        parts = []
        for k in range(self.n):  # one shard at a time; equal rows have equal costs
            sent = self.sent(k)
            each = docs.select(row.alias(key), _cost(sent, self.n, k, self.number, "text", of).alias(total)).groupBy(key).agg(F.max(total).alias(total))
            parts.append(written(each, "parts"))
            sent.destroy()
        every = parts[0]
        for x in parts[1:]:
            every = every.union(x)
        sums = written(every.groupBy(key).agg(F.sum(total).alias(total)), "sums")
        drop(*parts)
        joined = docs.withColumn(key, row).join(sums.withColumnRenamed(key, f"{key}_of"), F.col(key).eqNullSafe(F.col(f"{key}_of")), "left")
        return joined.withColumns({name: F.col(total) / n_chars, **beside}).drop(of, key, f"{key}_of", total)


class Model:
    """What judging needs: a scorer, and the highest log-perplexity by language."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        ship(docs.sparkSession)
        self.toxic = docs.sparkSession.sparkContext.broadcast(toxic_words(docs, labels))
        ids = written(trusted_ids(labels), "trusted")
        known = docs.where("text is not null and text <> '' and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
        text = only(known, ids).join(ids, "doc_id", "left_semi")
        aside = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
        models = written(kneser_ney(counted_models(text.where(~aside))), "models")
        names = sorted(x.model for x in models.select("model").distinct().collect())
        self.scorer = Scorer(models, names) if names else None
        self.fences: dict[str, float] = {}
        if names:
            each = F.explode(F.filter(F.array(F.lit(EVERY), F.concat(F.lit("="), "lang")), lambda x: x.isNotNull())).alias("name")
            tried = self.scorer.added(text.where(aside).select("doc_id", "text", each), F.col("name"), "x")
            good = written(tried.select("name", "x"), "good")  # a filter here would work the costs out twice, in two Python workers a task
            steps = good.where("x is not null").select("name", F.ceil(F.col("x") * STEPS).alias("x"))
            quantiles = F.array(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x)").cast("double") / STEPS for q in (0.5, HIGH)])
            rows = steps.groupBy("name").agg(quantiles.alias("q"), F.count("*").alias("n")).collect()
            total = sum(r.n for r in rows if r.name != EVERY)
            mean = sum(r.n * (r.q[1] - r.q[0]) for r in rows if r.name != EVERY) / total if total else 0.0
            for r in rows:
                smooth = SMOOTH_DOCUMENTS if r.name != EVERY else 0
                self.fences[r.name] = r.q[0] + (r.n * (r.q[1] - r.q[0]) + smooth * mean) / (r.n + smooth)
        self.langs = [x[1:] for x in sorted(self.fences) if x != EVERY]

    def model(self) -> Column:
        """The model that a document's language takes."""
        return F.when(F.col("lang").isin(self.langs), F.concat(F.lit("="), F.col("lang").cast("string"))).otherwise(F.lit(EVERY))

    def scored(self, docs: DataFrame, name: str, harmful: str | None = None) -> DataFrame:
        """`docs` with the log-perplexity of `text`, null where there is none, and whether harmful() holds."""
        beside = {harmful: self.harmful()} if harmful else {}
        if self.scorer:
            return self.scorer.added(docs, self.model(), name, beside)
        return docs.withColumns({name: F.lit(None).cast("double"), **beside})

    def harmful(self) -> Column:
        """Whether `text` holds a word that stands for toxic documents, or too many likely ones; false for a null text."""
        sent = self.toxic

        def harmful(texts: pa.Array) -> pa.Array:
            (toxic, alone), out = sent.value, []
            for _, text, offsets in _chunks([pa.record_batch([texts], names=["text"])]):
                words = Words(LOWER[text], offsets, APART)
                h = words.hashes().view(np.int64)
                at = np.minimum(np.searchsorted(toxic, h), len(toxic) - 1)
                hit, n = toxic[at] == h, len(offsets) - 1
                every, likely, sure = (np.bincount(words.doc[x], minlength=n) for x in (slice(None), hit, hit & alone[at]))
                out.append((sure > 0) | (likely > LIKELY_SHARE * every))
            return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

        return arrow_udf(harmful, "boolean")(F.col("text")) if len(sent.value[0]) else F.lit(False)

    def fence(self) -> Column:
        """A document's highest log-perplexity."""
        every = F.lit(self.fences.get(EVERY)).cast("double")
        own = [F.lit(x) for lang in self.langs for x in (lang, self.fences[f"={lang}"])]
        return F.coalesce(F.create_map(*own)[F.col("lang").cast("string")], every) if own else every


def _kept(x: Column, most: Column, harmful: Column) -> Column:
    """Not null: texts with characters that are neither beyond the fence nor harmful."""
    return F.coalesce(F.char_length("text") > 0, F.lit(False)) & F.coalesce(x <= most, F.lit(True)) & ~harmful


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, perplexity, threshold, kept) of every document."""
    model = Model(docs, labels)
    out = model.scored(docs.select("doc_id", "lang", "text"), "x", "harmful").withColumn("most", model.fence())
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.exp("x").alias("perplexity"), F.exp("most").alias("threshold"), _kept(F.col("x"), F.col("most"), F.col("harmful")).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model, x, harmful = Model(docs, labels), fresh(docs, "x"), fresh(docs, "harmful")
    return model.scored(docs, x, harmful).where(_kept(F.col(x), model.fence(), F.col(harmful))).select([f"`{c}`" for c in docs.columns])
