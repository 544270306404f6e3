"""Operator 12 against a plain version: every edit of every row tried, audits as strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quern.llm import queries, roles

WORD = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] += []
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        out[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest())
    return {conv: sorted(found, key=order) for conv, found in out.items()}


def cheapest(kinds):
    """kinds: (initial, must go, truncated) of rows. States: 0 nothing, 1 system, 2 user, 3 pair."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @cache
    def best(i, state, inserted):
        found = []
        if i == len(kinds):
            found += [(0, "")] * (state in (0, 3))
        else:
            initial, gone, cut = kinds[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 2, "D" + a))
            if not gone:
                for t in "sua":
                    if (state, t) in after and (t == initial or t != "s"):
                        c, a = best(i + 1, after[state, t], 0)
                        found.append((c + (t != initial) + 5 * cut, ("K" if t == initial else "R") + a))
        if inserted < 3:
            for t in "ua":
                if (state, t) in after:
                    c, a = best(i, after[state, t], inserted + 1)
                    found.append((c + 5, "I" + a))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def plain(rows):
    out = {}
    for conv, found in damage(rows).items():
        seen, kinds, counts, illegal = set(), [], [0, 0, 0], 0
        for _, role, text in found:
            words = WORD.findall(text)
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            kinds.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit = cheapest(tuple(kinds))
        lines, i = [], 0
        for e in audit:
            last = lines[-1][:1] if lines else ""
            made = "assistant" if last == "u" else "user"
            if e == "I":
                lines.append(f"{made}:")
                continue
            if e in "KR":
                lines.append(f"{found[i][1] if e == 'K' else made}:{found[i][2]}")
            i += 1
        turns = [r[0] for r in found if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(frame):
    rows = frame.select(COLUMNS).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_chart_against_every_edit():
    rng, chart = random.Random(7), roles.Chart()
    for _ in range(1500):
        weights = rng.choice([(1, 4, 4, 1), (4, 1, 1, 1), (1, 8, 1, 0), (0, 1, 8, 1)])
        kinds = [(rng.choices("sua?", weights)[0], rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(0, 14))]
        tokens = bytes(roles.FAULT * (roles.GONE if gone else roles.CUT if cut else roles.FINE) + roles.ROLES.index(r) for r, gone, cut in kinds)
        assert chart.repair(tokens) == cheapest(tuple(kinds)), kinds
    assert len(chart.columns) < 3000


def test_few_columns_for_many_rows():
    chart, tokens = roles.Chart(), bytes([0, *[1, 2] * 50_000, *[1] * 999, *[0] * 999, *[1, 2] * 10])
    cost, audit = chart.repair(tokens)
    assert len(audit) == len(tokens) and len(chart.columns) < 200 and audit.startswith("KKK")


def made(seed, conversations, turns):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(0, turns)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""])
            text = rng.choice(["Yes.", "No", " ", "", "Why?", f"Row {turn}.", "é\x0b", "a. \x1c", None, "end!\n\n"])
            rows += [(conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


EDGE = [(None, 1, "user", "A."), (None, None, "assistant", "B."), (-1, None, None, None), (-2, 2**40, "user", "x" * 50_000 + "."), *[(-3, 5, "user", "Copy.")] * 40]


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_against_plain(spark, parts):
    """One task, and so many that conversations reach over several."""
    rows = [*made(parts, 40, 9), *EDGE, *[(77, t, "user" if t % 2 else "assistant", f"Turn {t % 50}.") for t in range(600)]]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit("mine")).withColumn("part", F.lit(1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, want = got(roles.repaired(frame)), plain(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found.keys() == want.keys()
    assert [(c, found[c], want[c]) for c in want if found[c] != want[c]] == []


def test_no_rows(spark):
    assert roles.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(roles.repaired(spark.createDataFrame([(dropped, 0, "user", "x")], SCHEMA))) == {dropped: (0, 0, 0, 0, 0, 0, "", roles.NOTHING)}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op12_conversation_repair"](spark, SMALL)) == plain(rows)
