"""Operator 7: near-duplicate documents by b-bit MinHash signatures and a multi-index Hamming join.

A document's set: the distinct runs of SHINGLE words, A-Z in lower case; with fewer words the whole sequence as one.
Two documents are linked if their sets' Jaccard similarity is 0.8 or more, confirmed on the full sets.

1. One scan gives each document its set's size, a 128-bit fingerprint of the set and a signature of SYMBOLS symbols of
   16 bits (the low bits of that many minima). Documents of equal sets form a class.
2. Classes go through the join. Signatures of sets at similarity 0.8 differ in 12.8 of 64 symbols on average; DISTANCE 29
   is five standard deviations above. By the pigeonhole principle two signatures within it agree, in one of 15 chunks, up
   to one symbol; enumerating that error (each symbol of the chunk left out in turn) gives 64 keys, and every pair within
   the distance shares one.
3. Classes of a shared key are open. Those that hold too many shingles of their own (in no other open class) to link with
   any other of them leave. Every key has a pivot, the class in it that shares most keys with others, and all keys of one
   pivot form a group: two classes that share a key meet in the group of its pivot.
4. Each class tries the pivot that it shares most keys with: within the distance, then by full sets. As pivots go before
   their followers in one order, the links form a forest, whose roots are the first components.
5. Groups that hold several components are compared by exact counts over an inverted index: members of the pivot's
   component with the others, and the others with each other, dealt to blocks of bounded size. Only links that connect
   components not yet connected come out. So no link between components is lost, and a large group of copies costs one
   try a member and no row for each pair.

Null texts, and texts without words, have an empty set and link with nothing. Documents without an id get a null
component and are kept. Rows that share an id are one document: the links of each of its texts hold for all its rows.
An empty table gives an empty result. Other columns don't matter, whatever their names. Texts may have any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import LOWER, Words, mix, runs, text_chunks
from quern.operators.components import components
from quern.runtime import drop, fresh, ship, written

SHINGLE, SYMBOLS, CHUNKS = 4, 64, 15
#: Two errors in every chunk exceed it.
DISTANCE = 2 * CHUNKS - 1
LEAST_PERCENT = 80
#: Shingles of a block of a group, about.
BLOCK_SHINGLES = 200_000
#: Words of a filter on document ids, 64 bits each.
FILTER_WORDS = 1 << 18

_random = np.random.default_rng(7)
_A = (_random.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _random.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)[:, None]
_BOUNDS = np.linspace(0, SYMBOLS, CHUNKS + 1).astype(int)
_MULTIPLY = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
#: Of the two halves of a fingerprint.
_SALTS = (np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5))
#: Tells apart the keys of a chunk by the symbol left out.
_SALT = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingle_sets(text: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    words = Words(LOWER[text], offsets)
    hashes = words.hashes()
    at, h = runs(hashes, words.first, shingle)
    edges = np.searchsorted(at, words.first)
    out = [np.unique(h[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for k in np.flatnonzero((words.counts > 0) & (words.counts < shingle)):
        a, n = words.first[k], int(words.counts[k])
        _, one = runs(hashes[a : a + n], np.array([0, n]), n)
        out[k] = mix(one ^ np.uint64(n))
    return out


def signature(h: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of a non-empty set, 16 bits of each."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (_A * low[None, at : at + 2048] + _B).min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _signed(shingle: int):
    def batches(it):
        for part, text, offsets in text_chunks(it):
            sets = shingle_sets(text, offsets, shingle)
            n, (f1, f2), sigs = [], zip(*_fingerprints(sets), strict=True) if sets else ((), ()), []
            for h in sets:
                n.append(len(h))
                sigs.append(signature(h).tobytes() if len(h) else None)
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return batches


def _keys(it):
    """(key, class): every chunk with each of its symbols left out."""
    for b in it:
        if not len(b):
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
        keys = []
        for a, z in zip(_BOUNDS[:-1], _BOUNDS[1:], strict=True):
            terms = mix((sig[:, a:z] + np.uint64(1)) * _MULTIPLY[a:z])
            total = terms.sum(axis=1, dtype=np.uint64)
            keys += [mix(total - terms[:, k] + _SALT[a + k]) for k in range(z - a)]
        doc = b.column(0).to_numpy()
        yield pa.record_batch([pa.array(np.stack(keys, axis=1).reshape(-1).view(np.int64)), pa.array(np.repeat(doc, SYMBOLS))], names=["key", "class"])


def _confirmed(percent: int):
    """Of rows (a, b, sig_a, sig_b, set_a, set_b), the pairs within the distance whose full sets are similar enough."""

    def batches(it):
        for t in it:
            keep = []
            for p, q, x, y in zip(*(t.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if (np.frombuffer(p, np.uint16) != np.frombuffer(q, np.uint16)).sum() > DISTANCE:
                    keep.append(False)
                    continue
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return batches


def only(docs: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """Most rows of `docs` whose doc_id isn't in ids(doc_id) left out, before any shuffle, by a bitmap of bounded size;
    else (`inside` false) the rows that the bitmap rules out.

    The bitmap is broadcast as FILTER_WORDS rows of two numbers at most, however many ids there are."""
    slot_of = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(64 * FILTER_WORDS))
    slot, word, bits = (fresh(docs, x) for x in ("slot", "word", "bits"))
    bitmap = ids.select(slot_of("doc_id").alias(slot)).groupBy(F.shiftright(slot, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")).alias(bits))
    joined = docs.withColumn(slot, slot_of("doc_id")).withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(bitmap), word, "inner" if inside else "left")
    return joined.where(f"coalesce(shiftright({bits}, cast({slot} & 63 as int)) & 1, 0) = {int(inside)}").select([f"`{c}`" for c in docs.columns])


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` less the rows whose doc_id is among ids(doc_id); rows that the bitmap of only() rules out aren't shuffled."""
    likely, gone = only(docs, ids), fresh(docs, "gone")
    likely = likely.join(ids.select(F.col("doc_id").alias(gone)).hint("merge"), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    return only(docs, ids, False).unionByName(likely)


def _fingerprints(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    return [tuple(int(mix(h ^ salt).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0 for salt in _SALTS) for h in sets]


def _sets(shingle: int):
    """(doc_id, f1, f2, set): the shingles of each text, once a task for equal ones."""

    def batches(it):
        seen = set()
        for part, text, offsets in text_chunks(it):
            sets = shingle_sets(text, offsets, shingle)
            rows = [(d, *f, s.tobytes()) for d, f, s in zip(part.column(0).to_pylist(), _fingerprints(sets), sets, strict=True)]
            rows = [x for x in rows if x[:3] not in seen and not seen.add(x[:3])]
            if len(seen) > 200_000:  # as many as a task remembers; later equal ones go in the shuffle
                seen.clear()
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "f1", "f2", "set"])

    return batches


def _each_shingle(it):
    """(class, shingle) of rows (class, set)."""
    for b in it:
        for at in range(0, len(b), 64):
            part = b.slice(at, 64)
            sets = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            yield pa.record_batch([pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["class", "shingle"])


def _opened(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes that may link with another one: (class, doc, n, f1, f2, keys, central), and (class, sig, set) of all that share a key."""
    keys = classes.select("class", "sig").mapInArrow(_keys, "key long, class long")
    # written, as those below, so that a key of many rows is split when it is joined
    shared = written(keys.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("classes")).where("least < most").select("key", "classes"), "shared")
    of_class = keys.join(shared, "key").groupBy("class").agg(F.collect_list("key").alias("keys"), F.sum("classes").alias("central"))  # 64 keys at most
    open_ = written(of_class.join(classes, "class"), "open")
    sets = only(docs, open_.select(F.col("doc").alias("doc_id"))).mapInArrow(_sets(shingle), "doc_id long, f1 long, f2 long, set binary")
    sets = sets.groupBy(F.col("doc_id").alias("doc"), "f1", "f2").agg(F.first("set").alias("set"))
    sets = written(open_.select("class", "doc", "f1", "f2", "sig").join(sets, ["doc", "f1", "f2"]).select("class", "sig", "set"), "sets")
    each = sets.select("class", "set").mapInArrow(_each_shingle, "class long, shingle long")
    own = each.groupBy("shingle").agg(F.min("class").alias("class"), F.max("class").alias("most")).where("class = most").groupBy("class").agg(F.count("*").alias("own"))
    able = open_.drop("sig", "set").join(own, "class", "left").where(f"100 * (n - coalesce(own, 0)) >= {percent} * n").drop("own")
    able = written(able, "able")
    drop(shared, open_)
    return able, sets


def _grouped(able: DataFrame) -> DataFrame:
    """(class, n, pivots): the pivot of each of a class's keys that others share."""
    rows = able.select("class", "n", "central", F.explode("keys").alias("key"))
    pivot = rows.groupBy("key").agg(F.min(F.struct((-F.col("central")).alias("minus"), "class")).alias("p"), F.count("*").alias("classes")).where("classes > 1")
    pivot = written(pivot.select("key", F.col("p.class").alias("pivot")), "pivots")
    groups = written(rows.join(pivot, "key").groupBy("class").agg(F.first("n").alias("n"), F.collect_list("pivot").alias("pivots")), "groups")
    drop(pivot)
    return groups


def _first_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): class a links with b, the pivot other than itself that it shares most keys with."""
    most = F.expr("array_max(transform(array_distinct(filter(pivots, p -> p <> class)), p -> struct(size(filter(pivots, q -> q = p)) as shared, -p as minus)))")
    tries = groups.select(F.col("class").alias("a"), (-most["minus"]).alias("b")).where("b is not null")
    for side in "ab":
        tries = tries.join(sets.select(F.col("class").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("set").alias(f"set_{side}")), side)
    return tries.select("a", "b", "sig_a", "sig_b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long")


def _rooted(links: DataFrame) -> DataFrame:
    """(class, label): of a forest of links (a, b), the root above each a, by pointer jumping."""
    up = written(links.select(F.col("a").alias("class"), F.col("b").alias("label")), "links")
    while True:
        above = up.select(F.col("class").alias("label"), F.col("label").alias("above"))
        new = up.join(above, "label", "left").select("class", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved"))
        new = written(new, "roots")
        drop(up)
        up = new.select("class", "label")
        if new.where("moved").isEmpty():
            return up


def _later_links(groups: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels of components that a link between members of one group connects."""
    labelled = written(groups.join(roots, "class", "left").select("class", "n", F.coalesce("label", "class").alias("label"), F.array_distinct("pivots").alias("pivots")), "labelled")
    members = labelled.select("class", "n", "label", F.explode("pivots").alias("pivot"))
    parts = members.groupBy("pivot", "label").agg(F.sum("n").alias("n"), F.max(F.col("class") == F.col("pivot")).alias("own"))
    blocks = lambda n: F.ceil(n / BLOCK_SHINGLES).cast("int")
    sizes = parts.groupBy("pivot").agg(F.max(F.when(F.col("own"), F.col("label"))).alias("home"), blocks(F.sum(F.when(F.col("own"), F.col("n")))).alias("inside"), blocks(F.sum(F.when(~F.col("own"), F.col("n")))).alias("outside")).where("outside > 0")
    sizes = written(sizes, "sizes")
    # blocks of the pivot's component come first, then those of the others; a block of others meets every block
    dealt = members.join(sizes, "pivot").withColumn("at_home", F.col("label") == F.col("home"))
    hashed = F.xxhash64("class", "pivot")
    dealt = dealt.withColumn("block", F.when(F.col("at_home"), F.pmod(hashed, F.col("inside"))).otherwise(F.col("inside") + F.pmod(hashed, F.col("outside"))).cast("int"))
    met = F.sequence(F.when(F.col("at_home"), F.col("inside")).otherwise(F.lit(0)), F.col("inside") + F.col("outside") - 1)
    dealt = dealt.join(sets.select("class", "set"), "class").withColumn("with", F.explode(met))
    dealt = dealt.select("pivot", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "class", "label", "block", "set")
    found = written(dealt.repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high").mapInArrow(_compared(percent), "a long, b long"), "later-links")
    drop(labelled, sizes)
    return found


def _groups_of(it):
    """Rows of sorted batches, one table for each value of the first three columns."""
    held, last = [], None
    for b in it:
        keys = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if x == y:
                continue
            if held and last != (key := tuple(keys[x])):
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[x])
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _compared(percent: int):
    """Labels that links connect in each group of rows (pivot, low, high, class, label, block, set)."""

    def compare(t: pa.Table) -> list[tuple[int, int]]:
        label, block = (t.column(c).to_numpy() for c in ("label", "block"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        n = np.array([len(s) for s in sets])
        ends = np.cumsum(n)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owners = np.repeat(np.arange(len(n)), n)[np.argsort(token, kind="stable")]
        begin = np.cumsum(count) - count
        across = t.column("low")[0].as_py() != t.column("high")[0].as_py()
        names, group = np.unique(label, return_inverse=True)
        root = np.arange(len(names))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i in range(len(n) - 1):
            mine = token[ends[i] - n[i] : ends[i]]
            mine = mine[count[mine] > 1]
            if 100 * len(mine) < percent * n[i]:
                continue
            lengths = count[mine]
            at = np.repeat(begin[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            shared = np.bincount(owners[at], minlength=len(n))
            ok = (100 * shared >= percent * (n[i] + n - shared)) & (group != group[i])
            ok[: i + 1] = False
            if across:
                ok &= block != block[i]
            for j in np.flatnonzero(ok).tolist():
                x, y = find(group[i]), find(group[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((int(label[i]), int(label[j])))
        return found

    def batches(it):
        for t in _groups_of(it):
            if t.num_rows > 1 and (found := compare(t)):
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return batches


def _of_one_id(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(a, b): classes of texts that share an id; None where no two differ."""
    print_ = ["n_shingles", "f1", "f2"]
    known = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", F.struct(*print_).alias("print"))
    several = written(known.groupBy("doc_id").agg(F.min("print").alias("first"), F.max("print").alias("last")).where("first < last").select("doc_id", "first"), "several")
    if several.isEmpty():
        return None
    pairs = known.join(several, "doc_id").where("print <> first").select("first", "print").distinct()
    named = lambda side, name: classes.select(F.struct(F.col("n").alias("n_shingles"), "f1", "f2").alias(side), F.col("class").alias(name))
    return pairs.join(named("first", "a"), "first").join(named("print", "b"), "print").select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = LEAST_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each of `docs`."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(docs.mapInArrow(_signed(shingle), "doc_id long, n_shingles long, f1 long, f2 long, sig binary"), "signed")
    firsts = signed.where("doc_id is not null and n_shingles > 0").groupBy(F.col("n_shingles").alias("n"), "f1", "f2").agg(F.min(F.struct("doc_id", "sig")).alias("first"))
    # numbers of classes are fixed by the write
    classes = written(firsts.select(F.monotonically_increasing_id().alias("class"), "n", "f1", "f2", F.col("first.doc_id").alias("doc"), F.col("first.sig").alias("sig")), "classes")
    able, sets = _opened(docs.where("doc_id is not null"), classes, shingle, percent)
    groups = _grouped(able)
    roots = _rooted(_first_links(groups, sets, percent))
    edges = later = _later_links(groups, roots, sets, percent)
    same = _of_one_id(signed, classes)
    linked = able.select("class", "doc", "n", "f1", "f2")
    if same is not None:  # their classes need not be open
        edges, linked = edges.union(same).union(roots), classes.select("class", "doc", "n", "f1", "f2")
    linked = linked.join(roots, "class", "left").withColumn("label", F.coalesce("label", "class"))
    if not edges.isEmpty():
        of_label = components(edges)
        linked = linked.join(of_label, linked.label == of_label.node, "left").withColumn("label", F.coalesce("component", "label"))
    linked = written(linked.select("doc", "n", "f1", "f2", "label"), "linked")
    drop(able, sets, groups, later, roots)
    least = linked.groupBy("label").agg(F.min("doc").alias("component_id"), F.count("*").alias("classes")).where("classes > 1")
    linked = linked.join(least, "label").select("n", "f1", "f2", "component_id")
    of_class = classes.select("n", "f1", "f2", F.col("doc").alias("component_id")).union(linked).groupBy(F.col("n").alias("n_shingles"), "f1", "f2").agg(F.min("component_id").alias("component_id"))
    of_class = written(of_class, "components")
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(of_class, ["n_shingles", "f1", "f2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = LEAST_PERCENT) -> DataFrame:
    """One document of each component, with all its columns. Only texts that may go are shuffled."""
    gone = written(near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct(), "gone")
    return without(docs, gone)
