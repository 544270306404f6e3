"""Operator 6 [native]: secrets by fixed patterns and by sliding-window entropy, in DataFrame functions alone.

Base spans: three patterns, leftmost matches that don't overlap, failing ones dropped. Added spans: candidate strings of
a character class (hexadecimal; letters, digits and base64 signs) are scanned by a window of fixed length, whose Shannon
entropy follows from counts that change by one character in and one out; windows at or above the class's threshold are
joined to spans. An allow-list of patterns suppresses candidates, and what a base span covers isn't added again.

One projection, no shuffle. Null texts count as empty and yield no spans; repeated rows and ids are scanned each on
their own; offsets are code points, end exclusive. Texts may have any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import fresh

#: The base patterns, in the order in which kinds are listed. Runs of one class have their least length
#: in the pattern, which finds the same as dropping shorter ones; an assignment is dropped after the match.
BASE = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
#: A text without these has no match of the kind; cheap to look for.
NEEDS = {"assign": r"[:=]", "access": "AKIA", "hex": r"[0-9a-f]{16}"}
LEAST_ASSIGNED = 8
#: Character classes of the entropy scan (a candidate belongs to the first that holds all of it): (candidate pattern, alphabet, window length, least bits a character).
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9+/_=-])[0-9a-fA-F]{24,}(?![A-Za-z0-9+/_=-])", "0123456789abcdefABCDEF", 20, 2.9),
    "entropy_base64": (r"(?<![A-Za-z0-9+/_=-])(?![0-9a-fA-F]++(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.6),
}
#: Characters of a candidate without digits for each change from a small to a capital letter, at most.
MIXED = 6
#: Matches that are located together, and counts in one number.
BLOCK, SLOTS, SLOT_BITS = 256, 12, 5
#: Entropies are compared as whole numbers, in steps of one to so many.
SCALE = 1 << 30
#: Candidates that match one of these are no secrets: placeholders, counting sequences, one character repeated, UUIDs.
ALLOW = (r"(?i)example|placeholder|changeme|dummy|x{6}", r"0123456789|abcdefghij|ABCDEFGHIJ", r"(.)\1{7}", r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def _located(text: Column, pattern: str) -> Column:
    """array<struct<at, n, s>>: start, length and string of each match. The pieces between matches give the starts."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<at:int,n:int,s:string>>")
    pieces = F.arrays_zip(F.transform(F.slice(between, 1, F.size(hits)), lambda x: F.char_length(x)).alias("gap"), hits.alias("s"))
    start = F.struct(F.lit(0).alias("end"), empty.alias("found"))

    def add(acc: Column, x: Column) -> Column:
        n = F.char_length(x["s"])
        here = F.struct((acc["end"] + x["gap"]).alias("at"), n.alias("n"), x["s"].alias("s"))
        return F.struct((acc["end"] + x["gap"] + n).alias("end"), F.concat(acc["found"], F.array(here)).alias("found"))

    def parts(all_: Column) -> Column:
        """Blocks of BLOCK pieces, each located from its own begin."""
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda k: F.aggregate(F.slice(all_, k * BLOCK + 1, BLOCK), start, add))

    def placed(blocks: Column) -> Column:
        ends = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["end"])))
        shifted = F.zip_with(blocks, F.slice(ends, 1, F.size(blocks)), lambda x, begin: F.transform(x["found"], lambda m: F.struct((m["at"] + begin).alias("at"), m["n"].alias("n"), m["s"].alias("s"))))
        return F.flatten(shifted)

    return F.when(F.size(hits) > 0, _let(_let(pieces, parts), placed)).otherwise(empty)


def _let(x: Column, f) -> Column:
    """f of x, with x computed once."""
    return F.transform(F.array(x), f)[0]


def _spans(found: Column, kind: int) -> Column:
    """array<struct<start, kind, end>> of located strings."""
    return F.transform(found, lambda x: F.struct(x["at"].alias("start"), F.lit(kind).alias("kind"), (x["at"] + x["n"]).alias("end")))


_EMPTY = "array<struct<start:int,kind:int,end:int>>"


def base_spans(text: Column, name: str) -> Column:
    """Spans of one base kind."""
    found = _located(text, BASE[name])
    if name == "assign":  # the second group of the same leftmost matches, in the same order
        values = F.regexp_extract_all(text, F.lit(BASE[name]), F.lit(2))
        kept = F.filter(F.arrays_zip(found.alias("m"), values.alias("v")), lambda x: F.char_length(x["v"]) >= LEAST_ASSIGNED)
        found = F.transform(kept, lambda x: x["m"])
    return F.when(text.rlike(NEEDS[name]), _spans(found, list(BASE).index(name))).otherwise(F.array().cast(_EMPTY))


def _hot(candidate: Column, alphabet: str, window: int, least: float) -> Column:
    """Maximal stretches of the candidate whose windows all reach the entropy: array<struct<a, b>>, offsets in the candidate."""
    index = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    before = lambda ix: F.concat(F.array_repeat(F.lit(-1), window), F.slice(ix, 1, F.greatest(F.size(ix) - window, F.lit(0))))
    pairs = _let(index, lambda ix: F.arrays_zip(ix.alias("new"), before(ix).alias("old")))
    weight = F.array(*[F.lit(0 if c == 0 else round(c * math.log2(c) * SCALE)) for c in range(window + 2)])  # c log2 c
    most = math.floor(window * (math.log2(window) - least) * SCALE)  # of the sum, in a hot window
    none = F.array().cast("array<struct<a:int,b:int>>")
    slots = -(-len(alphabet) // SLOTS)
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), slots).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), none.alias("closed"))

    def step(acc: Column, x: Column) -> Column:
        """One character in, one out (-1: none yet)."""
        new, old = x["new"], x["old"]
        slot_of, bit_of = (lambda i: F.floor(i / SLOTS).cast("int")), (lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), SLOT_BITS * F.pmod(i, F.lit(SLOTS))))
        count = lambda i: F.call_function("shiftright", F.get(acc["counts"], slot_of(i)), SLOT_BITS * F.pmod(i, F.lit(SLOTS))).bitwiseAND((1 << SLOT_BITS) - 1).cast("int")
        same, first = new == old, old < 0
        up, down = count(new), count(old)
        total = acc["sum"] + F.when(same, F.lit(0)).otherwise(F.get(weight, up + 1) - F.get(weight, up) + F.when(first, F.lit(0)).otherwise(F.get(weight, down - 1) - F.get(weight, down)))
        moved = F.transform(acc["counts"], lambda c, j: c + F.when(j == slot_of(new), bit_of(new)).otherwise(F.lit(0)) - F.when(~first & (j == slot_of(old)), bit_of(old)).otherwise(F.lit(0)))
        hot = (acc["i"] >= window - 1) & (total <= most)
        a, b = acc["i"] - (window - 1), acc["i"] + 1
        joins = hot & (acc["a"] >= 0) & (acc["b"] >= a)
        closes = hot & (acc["a"] >= 0) & (acc["b"] < a)
        open_ = F.struct(acc["a"].alias("a"), acc["b"].alias("b"))
        return F.struct(
            F.when(same, acc["counts"]).otherwise(moved).alias("counts"), total.alias("sum"), b.alias("i"),
            F.when(joins | ~hot, acc["a"]).otherwise(a).alias("a"), F.when(hot, b).otherwise(acc["b"]).alias("b"),
            F.when(closes, F.concat(acc["closed"], F.array(open_))).otherwise(acc["closed"]).alias("closed"),
        )

    return F.aggregate(pairs, zero, step, lambda acc: F.when(acc["a"] < 0, acc["closed"]).otherwise(F.concat(acc["closed"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))))


def entropy_spans(text: Column, name: str, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of one character class that look random."""
    pattern, alphabet, window, least = CLASSES[name]
    kind = len(BASE) + list(CLASSES).index(name)
    kept = F.filter(_located(text, pattern), lambda x: ~_any(x["s"], allow))
    if name == "entropy_base64":
        kept = F.filter(kept, lambda x: x["s"].rlike("[0-9]") | (MIXED * F.size(F.regexp_extract_all(x["s"], F.lit("[a-z](?=[A-Z])"), F.lit(0))) >= x["n"]))
    each = F.transform(kept, lambda x: F.transform(_hot(x["s"], alphabet, window, least), lambda y: F.struct((x["at"] + y["a"]).alias("start"), F.lit(kind).alias("kind"), (x["at"] + y["b"]).alias("end"))))
    return F.when(text.rlike(r"[A-Za-z0-9+/_=-]{20}"), F.flatten(each)).otherwise(F.array().cast(_EMPTY))


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(p)
    return out


def _joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined, by start, then kind as listed."""
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> tuple[dict[str, Column], Column]:
    """Base spans by kind (assign, access, hex), and added (entropy) spans that no base span covers."""
    text = F.coalesce(text, F.lit(""))
    base = {k: base_spans(text, k) for k in BASE}
    added = F.concat(*[entropy_spans(text, k, allow) for k in CLASSES])
    covered = lambda a, of: F.exists(of, lambda b: (b["start"] <= a["start"]) & (b["end"] >= a["end"]))
    return base, F.when(F.size(added) > 0, _let(F.struct(added.alias("added"), F.concat(*base.values()).alias("base")), lambda x: F.filter(x["added"], lambda a: ~covered(a, x["base"])))).otherwise(added)


def scan(docs: DataFrame, text_column: str = "text", allow: tuple[str, ...] = ALLOW, out: str = "secrets") -> DataFrame:
    """`docs` with a column `out` (longer by underscores where the table has that name): struct of assign, access, hex and added,
    arrays of spans (start, kind, end)."""
    base, added = found_spans(F.col(f"`{text_column}`"), allow)
    return docs.withColumn(fresh(docs, out), F.struct(*[x.alias(k) for k, x in base.items()], added.alias("added")))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    found = scan(docs.select("doc_id", "text"))
    of = lambda k: F.col(f"secrets.{k}")
    base, names = F.concat(*map(of, BASE)), [*BASE, *CLASSES]
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base, names), 256).alias("base_sha256"),
        _joined(F.concat(base, of("added")), names).alias("spans"),
    )
