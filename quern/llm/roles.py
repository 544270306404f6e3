"""Operator 12: repair of the role structure of conversations by error-correcting Earley parsing.

The grammar of roles (system, user, assistant by their initials) is left-recursive, so every item of the chart begins at the
conversation's first row: a column holds a bounded number of dotted productions. Weighted productions stand for edits of a row: keep,
rerole, delete, insert. Of each item a column retains the least (cost, audit), the audit being the edits' initials in order; the
completed chart's least item gives the repair.

Audits aren't carried as strings. Items of one column have consumed the same rows and their audits end with one of them, so none
is a proper prefix of another: the order of two audits is decided by the order of those they extend and by the last row's edits,
and a column holds ranks. Costs are kept relative to the column's least; an item dearer than WINDOW beyond it can't win, because any
item reaches what another can at that cost. So there are finitely many columns, each worked out once, and a row costs one lookup.

Rows are damaged first (`damaged`), repeated rows counted instead of copied, and dealt by ranges of (conversation, turn, hash), so that
one conversation of any length lies in as many tasks as its rows need. A conversation that lies whole in a task is parsed there. One that
reaches over a task's border is parsed by segments: each segment gives, for every item it may begin with, the cost and rank of every
item it may end with; these small tables are combined by conversation, and each segment then spells its own part of the audit. Only
the hash of the repaired text, which is sequential by its definition, reads such a conversation in one task, row by row.

Nulls: a null id or turn is a space in the damage's key, a null role or text a space. Rows of a null conv_id are one conversation. Rows of
one turn are ordered by the hash of their role and text. A role without an initial of the grammar can't be kept. Equal rows of one turn are duplicates of
the first. Conversations without rows after damage have zeros, an empty audit and the hash of no bytes. An empty table gives an
empty result; texts may have any length; extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import claim
from quern.runtime import ship, written

#: The grammar, what edits cost, and what stands between words.
GRAMMAR = [("S", ""), ("S", "P"), ("P", "ua"), ("P", "sua"), ("P", "Pua")]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
MADE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\f\r"
#: Two inserts end a pair, a third begins one, and a system row that another item keeps is deleted.
WINDOW = 3 * INSERT + DELETE
#: A row's token: its role's place in ROLES, plus FAULT times what is wrong with it.
ROLES, FAULT = "sua?", 4
FINE, GONE, CUT = 0, 1, 2
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()

Item = tuple[int, int]


def closed(item: Item) -> list[Item]:
    """What an item stands for once completions and predictions, which cost nothing, are made: items that wait for a row, or for the end."""
    left, right = GRAMMAR[item[0]]
    if item[1] < len(right):
        return [item] if right[item[1]].islower() else []  # one that waits for pairs begins with the conversation, where all are predicted
    if left == "S":
        return [item]
    return [x for n, (_, r) in enumerate(GRAMMAR) if r[:1] == left for x in closed((n, 1))]


BEGIN = [x for n in range(len(GRAMMAR)) for x in closed((n, 0))]


class Column:
    """A column of the chart: (item, cost beyond the least, rank of its audit), and the columns that follow it by token."""

    def __init__(self, items: tuple[tuple[Item, int, int], ...]):
        self.items, self.next = items, {}


class Chart:
    """Columns, each made once."""

    def __init__(self):
        self.columns: dict[tuple, Column] = {}

    def column(self, items: list[Item] | tuple) -> Column:
        items = tuple((x, 0, 0) for x in items) if items and isinstance(items[0][0], int) else tuple(items)
        return self.columns.setdefault(items, Column(items))

    def reached(self, column: Column) -> dict[Item, tuple[int, int, str, Item]]:
        """Items of a column and those that inserts lead to: cost, rank, inserts, item of the column."""
        best = {item: (cost, rank, "", item) for item, cost, rank in column.items}
        todo = list(best)
        while todo:
            n, dot = todo.pop()
            cost, rank, edits, source = best[n, dot]
            if GRAMMAR[n][1][dot : dot + 1] in [*MADE]:
                for x in closed((n, dot + 1)):
                    found = (cost + INSERT, rank, edits + "I", source)
                    if x not in best or found[:3] < best[x][:3]:
                        best[x] = found
                        todo.append(x)
        return best

    def step(self, column: Column, token: int) -> tuple[Column, int, dict[Item, tuple[Item, str]]]:
        """(next column, what its least cost adds, for each of its items the item before and the edits between)."""
        role, fault = ROLES[token % FAULT], token // FAULT
        best: dict[Item, tuple[int, int, str, Item]] = {}

        def offer(item, cost, rank, edits, source):
            if item not in best or (cost, rank, edits) < best[item][:3]:
                best[item] = (cost, rank, edits, source)

        for (n, dot), (cost, rank, edits, source) in self.reached(column).items():
            offer((n, dot), cost + DELETE, rank, edits + "D", source)
            waits = GRAMMAR[n][1][dot : dot + 1]
            if waits and fault != GONE and (waits == role or waits in MADE):
                spent = (KEEP if waits == role else REROLE) + TRUNCATED * (fault == CUT)
                for x in closed((n, dot + 1)):
                    offer(x, cost + spent, rank, edits + ("K" if waits == role else "R"), source)
        least = min(x[0] for x in best.values())
        best = {item: x for item, x in best.items() if x[0] - least <= WINDOW}
        ranks = {x: i for i, x in enumerate(sorted({x[1:3] for x in best.values()}))}
        after = self.column(tuple((item, x[0] - least, ranks[x[1:3]]) for item, x in sorted(best.items())))
        return after, least, {item: (x[3], x[2]) for item, x in best.items()}

    def parse(self, column: Column, tokens: bytes) -> tuple[Column, int, list]:
        """(last column, its least cost, steps) over rows."""
        total, steps = 0, []
        for t in tokens:
            found = column.next.get(t)
            if found is None:
                found = column.next[t] = self.step(column, t)
            steps.append(found)
            column = found[0]
            total += found[1]
        return column, total, steps

    def end(self, column: Column) -> tuple[int, int, str, Item]:
        """The least (cost, rank, inserts, item) with which the conversation is complete."""
        return min(x for (n, dot), x in self.reached(column).items() if GRAMMAR[n][0] == "S" and dot == len(GRAMMAR[n][1]))

    def audit(self, steps: list, item: Item) -> str:
        """The edits that lead to an item of the last column."""
        out = []
        for _, _, back in reversed(steps):
            item, edits = back[item]
            out.append(edits)
        return "".join(reversed(out))

    def repair(self, tokens: bytes) -> tuple[int, str]:
        """The least (cost, audit) of a whole conversation."""
        column, total, steps = self.parse(self.column(BEGIN), tokens)
        cost, _, inserts, item = self.end(column)
        return total + cost, self.audit(steps, item) + inserts


#: Items that share an audit are entered together: (their sign, all of them).
ENTRIES: dict[Item, list[Item]] = {x[0]: x for x in [BEGIN] + [closed((n, d)) for n, (_, r) in enumerate(GRAMMAR) for d in range(1, len(r) + 1)] if x}

_chart: list[Chart] = []


def chart() -> Chart:
    """This worker's columns."""
    claim("roles", _chart.clear)
    if not _chart:
        _chart.append(Chart())
    return _chart[0]


class Repaired:
    """The hash of a repaired conversation, fed with rows and their edits in order."""

    def __init__(self):
        self.hash, self.any, self.last = hashlib.sha256(), False, ""

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any, self.last = True, role[:1]

    def made(self) -> str:
        return MADE["a" if self.last == "u" else "u"]

    def row(self, edit: str, role: str, text: str) -> None:
        if edit == "K":
            self.put(role, text)
        elif edit == "R":
            self.put(self.made(), text)

    def inserts(self, audit: str, at: int) -> int:
        """The place after the inserts that begin at a place."""
        while at < len(audit) and audit[at] == "I":
            self.put(self.made(), "")
            at += 1
        return at


class Segment:
    """Counts and tokens of rows in a row: (turn, role, n copies, blank, cut, seen earlier)."""

    def __init__(self):
        self.counts, self.tokens = [0, 0, 0, 0], bytearray()  # blank, duplicate, truncated, illegal
        self.turns, self.first_turn, self.last_turn, self.first, self.last = 0, None, None, None, None

    def add(self, turn, role: str, n: int, blank: bool, cut: bool, late: bool) -> None:
        if not n:
            return
        sign = role[:1]
        if self.last is None:
            self.first = sign
        elif self.last + sign not in LEGAL:
            self.counts[3] += 1
        self.counts[3] += n - 1
        self.last = sign
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        gone = bytes([FAULT * GONE])
        if blank:
            self.counts[0] += n
            self.tokens += gone * n
            return
        self.counts[1] += n if late else n - 1
        self.counts[2] += cut and not late
        if late:
            self.tokens += gone * n
        else:
            self.tokens.append(FAULT * (CUT if cut else FINE) + (ROLES.index(sign) if sign and sign in "sua" else 3))
            self.tokens += gone * (n - 1)

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows as the contract damages them, equal ones counted; rows that it drops have n = 0 and no text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(20))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 0, "").when(F.col("code") == 4, "user").otherwise(F.col("role"))
    n = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), n.alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def dealt(rows: DataFrame) -> DataFrame:
    """Damaged rows with their faults, in order, dealt by ranges."""
    words = F.rtrim(F.col("text"), F.lit(SPACE))
    marked = rows.select(
        "conv_id", "turn", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text"))).alias("h"), "role", "text", "n",
        (words == "").alias("empty"), (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    by = ["conv_id", "turn", "h"]
    return marked.repartitionByRange(*by).sortWithinPartitions(*by)


#: What a task leaves of conversations that may go on in another one.
OPEN = "part int, turn long, h binary, role string, text string, n long, empty boolean, cut boolean"


def _parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations within a task; the first and last one's rows as they are."""
    from pyspark import TaskContext

    part, known, names = TaskContext.get().partitionId(), chart(), [x.split()[0] for x in f"{RESULT}, {OPEN}".split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(a, kinds[b]) for a, b in (x.split() for x in f"{RESULT}, {OPEN}".split(", "))])
    own = len(RESULT.split(", "))
    first, at, rows = True, None, []

    def batch(found: list, begin: int) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        place = {0: 0} | {begin + i: i + 1 for i in range(len(columns) - 1)}
        return pa.record_batch([pa.array(columns[place[i]], schema.field(i).type) if i in place else pa.nulls(len(found), schema.field(i).type) for i in range(len(names))], schema=schema)

    def result(conv, rows: list) -> tuple:
        seen, segment = set(), Segment()
        for turn, h, role, _, n, blank, cut in rows:
            segment.add(turn, role, n, blank, cut, h in seen)
            if n:
                seen.add(h)
        cost, audit = known.repair(bytes(segment.tokens))
        out, place = Repaired(), 0
        for _, _, role, text, n, _, _ in rows:
            for _ in range(n):
                place = out.inserts(audit, place)
                out.row(audit[place], role, text)
                place += 1
        out.inserts(audit, place)
        return (conv, segment.gaps(), *segment.counts, cost, audit, out.hash.hexdigest())

    for b in it:
        done, left = [], []
        columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "h", "role", "text", "n", "empty", "cut")]
        for conv, *row in zip(*columns, strict=True):
            if at is None or conv != at[0]:
                if rows:
                    done.append(result(at[0], rows))
                first, at, rows = at is None, (conv,), []
            if first:
                left.append((conv, part, *row))
            else:
                rows.append(row)
        if done:
            yield batch(done, 1)
        if left:
            yield batch(left, own)
    if rows:
        yield batch([(at[0], part, *row) for row in rows], own)


def _segments(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """One segment's counts, tokens, and the costs and ranks of the items it may end with, by the items it may begin with."""
    rows = group.sort_by([("turn", "ascending"), ("h", "ascending")]).select(["turn", "role", "n", "empty", "cut", "late"])
    rows = pa.concat_tables([rows.filter(pc.is_null(rows["turn"])), rows.filter(pc.is_valid(rows["turn"]))])
    segment, known, table = Segment(), chart(), []
    for row in zip(*[rows.column(c).to_pylist() for c in range(rows.num_columns)], strict=True):
        segment.add(*row)
    for sign, items in ENTRIES.items():
        column, total, _ = known.parse(known.column(items), bytes(segment.tokens))
        for item, cost, rank in column.items:
            if item in ENTRIES:
                table += [*sign, *item, total + cost, rank]
    head = group.select(["turn", "h"])
    nulls = head.filter(pc.is_null(head["turn"]))
    start = min(nulls["h"].to_pylist()) if nulls.num_rows else None
    lowest = None if nulls.num_rows else pc.min(head["turn"]).as_py()
    start = start or min(head.filter(pc.equal(head["turn"], lowest))["h"].to_pylist())
    values = [key[0].as_py(), key[1].as_py(), lowest, start, *segment.counts, segment.turns, segment.first_turn, segment.last_turn, segment.first, segment.last, bytes(segment.tokens), table]
    return pa.table([[v] for v in values], schema=_SEGMENT)


_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("turn", pa.int64()), ("h", pa.binary()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("tokens", pa.binary()), ("ends", pa.list_(pa.int64())),
])
SEGMENT = "conv_id long, part int, turn long, h binary, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first string, last string, tokens binary, ends array<bigint>"
CHOSEN = "conv_id long, part int, place int, entry array<int>, leave array<int>, inserts int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _combined(group: pa.Table) -> pa.Table:
    """The way through a conversation's segments: for each, the items it begins and ends with. A row a segment, whatever its rows."""
    parts = sorted(group.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["h"]))
    known, at, ways = chart(), {BEGIN[0]: (0, 0)}, []
    counts, turns, first_turn, last_turn, last = [0, 0, 0, 0], 0, None, None, None
    for r in parts:
        counts = [a + r[c] for a, c in zip(counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
        if r["first"] is not None:
            counts[3] += last is not None and last + r["first"] not in LEGAL
            last = r["last"]
        if r["first_turn"] is not None:
            turns += r["turns"] - (r["first_turn"] == last_turn)
            first_turn, last_turn = r["first_turn"] if first_turn is None else first_turn, r["last_turn"]
        best, e = {}, r["ends"]
        for i in range(0, len(e), 6):
            entry, leave = (e[i], e[i + 1]), (e[i + 2], e[i + 3])
            if entry in at:
                found = (at[entry][0] + e[i + 4], at[entry][1], e[i + 5], entry)
                if leave not in best or found < best[leave]:
                    best[leave] = found
        ranks = {x: k for k, x in enumerate(sorted({x[1:3] for x in best.values()}))}
        ways.append({item: x[3] for item, x in best.items()})
        at = {item: (x[0], ranks[x[1:3]]) for item, x in best.items()}
    column = Column(tuple((x, cost, rank) for sign, (cost, rank) in at.items() for x in ENTRIES[sign]))
    cost, _, inserts, item = known.end(column)
    item = next(sign for sign, items in ENTRIES.items() if item in items and sign in at)
    gaps = 0 if first_turn is None else last_turn - first_turn + 1 - turns
    out = []
    for place in range(len(parts) - 1, -1, -1):
        entry = ways[place][item]
        out.append({
            "conv_id": parts[place]["conv_id"], "part": parts[place]["part"], "place": place, "entry": entry, "leave": item, "inserts": len(inserts) if place == len(parts) - 1 else 0,
            "gaps": gaps, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": counts[3], "cost": cost,
        })
        item = entry
    numbers = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("entry", pa.list_(pa.int32())), ("leave", pa.list_(pa.int32())), ("inserts", pa.int32()), *numbers]))


def _audits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each segment, from its tokens and the items that it begins and ends with."""
    known = chart()
    for b in it:
        out = []
        for tokens, entry, leave, inserts in zip(*[b.column(c).to_pylist() for c in ("tokens", "entry", "leave", "inserts")], strict=True):
            steps = known.parse(known.column(ENTRIES[tuple(entry)]), tokens)[2]
            out.append(known.audit(steps, tuple(leave)) + "I" * inserts)
        keep = [c for c in b.schema.names if c not in ("tokens", "entry", "leave", "inserts")]
        yield pa.record_batch([*[b.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, "audit"])


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's repaired text, from audits and rows in order; one row is held at a time."""
    at, out, audit, place = None, Repaired(), "", 0
    done: list = []

    def end():
        if at is not None:
            out.inserts(audit, place)
            done.append((at[0], out.hash.hexdigest()))

    for b in it:
        for conv, edits, role, text, n in zip(*[b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "n")], strict=True):
            if at is None or conv != at[0]:
                end()
                at, out, audit, place = (conv,), Repaired(), "", 0
            if edits is not None:
                out.inserts(audit, place)
                audit, place = edits, 0
                continue
            for _ in range(n):
                place = out.inserts(audit, place)
                out.row(audit[place], role, text)
                place += 1
        if done:
            yield pa.record_batch([pa.array([x[i] for x in done], t) for i, t in ((0, pa.int64()), (1, pa.string()))], names=["conv_id", "repaired_sha256"])
            done.clear()
    end()
    if done:
        yield pa.record_batch([pa.array([x[i] for x in done], t) for i, t in ((0, pa.int64()), (1, pa.string()))], names=["conv_id", "repaired_sha256"])


def _open(rows: DataFrame) -> DataFrame:
    """Results of conversations that may lie in several tasks' rows."""
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    # where a role and text have been first, of those that come at different turns
    seen = rows.where("n > 0").groupBy("conv_id", "h").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.max(F.isnull("turn")).alias("none"))
    seen = seen.where("least < most or (none and least is not null)").withColumnRenamed("conv_id", "seen_id").withColumnRenamed("h", "seen_h")
    late = F.col("least").isNotNull() & F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("least")))
    light = rows.select("conv_id", "part", "turn", "h", F.substring("role", 1, 1).alias("role"), "n", "empty", "cut")
    light = light.join(seen, light["conv_id"].eqNullSafe(seen["seen_id"]) & (light["h"] == seen["seen_h"]), "left").select(*light.columns, F.coalesce(late, F.lit(False)).alias("late"))
    segments = written(light.groupBy("conv_id", "part").applyInArrow(_segments, SEGMENT), "segments")
    chosen = written(segments.drop("tokens").groupBy("conv_id").applyInArrow(_combined, CHOSEN), "chosen")
    held = segments.select("conv_id", "part", "tokens")
    both = held.join(chosen, same(held, chosen) & (held["part"] == chosen["part"])).drop(held["conv_id"], held["part"])
    both = both.select(*[x.split()[0] for x in CHOSEN.split(", ")], "tokens")
    kept = ", ".join(x for x in CHOSEN.split(", ") if x.split()[0] not in ("entry", "leave", "inserts"))
    audits = written(both.mapInArrow(_audits, f"{kept}, audit string"), "audits")
    # audits before their rows, in order
    places = audits.select(F.col("conv_id").alias("own_id"), F.col("part").alias("own_part"), "place")
    text = rows.join(places, rows["conv_id"].eqNullSafe(places["own_id"]) & (rows["part"] == places["own_part"]))
    text = text.select("conv_id", "place", F.lit(1).alias("kind"), "turn", "h", F.lit(None).cast("string").alias("audit"), "role", "text", "n")
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    heads = audits.select("conv_id", "place", F.lit(0).alias("kind"), null("long", "turn"), null("binary", "h"), "audit", null("string", "role"), null("string", "text"), null("long", "n"))
    lines = heads.union(text).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind", "turn", "h")
    hashes = lines.select("conv_id", "audit", "role", "text", "n").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    whole = audits.groupBy("conv_id").agg(
        *[F.first(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    return whole.join(hashes, same(whole, hashes)).select(whole["conv_id"], *[x.split()[0] for x in RESULT.split(", ")][1:])


def repaired(rows: DataFrame) -> DataFrame:
    """The contract's row for each conversation."""
    ship(rows.sparkSession)
    every = written(dealt(damaged(rows)).mapInArrow(_parsed, f"{RESULT}, {OPEN}"), "conversations")
    results = [x.split()[0] for x in RESULT.split(", ")]
    return every.where("part is null").select(results).unionByName(_open(every.where("part is not null").select("conv_id", *[x.split()[0] for x in OPEN.split(", ")])))
