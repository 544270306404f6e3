"""Operator 10's boundaries: chosen by content, resistant to shifts, and what the first round leaves to the second."""

import random

import numpy as np

from quern.llm import lines


def chunks(texts, of=lines.defined_chunks):
    data = [t.encode() for t in texts]
    found = of(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    return [(d, data[d][a:z].decode(), h) for d, a, z, h, _ in zip(*[x.tolist() for x in found], strict=True)]


def plain(text):
    """Boundaries by a plain walk over lines: behind each line whose window's hash is a multiple of the divisor."""
    rows = [r for r in text.split("\n") if r]
    h = {t: k for _, t, k in chunks([f"{a}\n{b}" for a, b in zip(rows, rows[1:])], lines.chunks_of)}
    out, own = [], []
    for i, r in enumerate(rows):
        own.append(r)
        if i + 1 == len(rows) or i and h[f"{rows[i - 1]}\n{r}"] % lines.DIVISOR == 0:
            out += ["\n".join(own)] * (len(own) >= lines.LINES)
            own = []
    return out


def test_boundaries_by_content():
    rng = random.Random(1)
    texts = ["\n".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts = [*texts, "", "one", "one\ntwo"]
    found = chunks(texts)
    for d, text in enumerate(texts):
        assert [c for k, c, _ in found if k == d] == plain(text)
    assert len({h for *_, h in found}) == len({c for _, c, _ in found})


def test_boundaries_resist_shifts():
    """Lines put in anywhere change no chunk but those around them; cuts at fixed places would lose nearly all."""
    rng = random.Random(2)
    body = [f"line {rng.random()}" for _ in range(400)]
    whole = {c for _, c, _ in chunks(["\n".join(body)])}
    assert 40 < len(whole) < 200
    for at in (0, 1, 57, 399, 400):
        moved = {c for _, c, _ in chunks(["\n".join([*body[:at], "new", "newer", *body[at:]])])}
        assert len(whole - moved) <= 3
    fixed = lambda rows: {"\n".join(rows[i : i + 4]) for i in range(0, len(rows), 4)}
    assert len(fixed(body) & fixed(["new", *body])) < 3 < len(whole & {c for _, c, _ in chunks(["\n".join(["new", *body])])})


def test_rounds(spark):
    """The first round finds the inner chunks of a long passage, the second its edges and short passages; both together all of it."""
    rng = random.Random(3)
    own = lambda n: [f"own {rng.random()}" for _ in range(n)]
    long, short = [f"long {i}" for i in range(80)], ["short 1", "short 2"]
    rows = [(1, own(5) + long + own(2)), (2, own(2) + long[3:70] + own(4)), (3, short + own(3)), (4, own(3) + short), (5, long[10:60] + short)]
    docs = spark.createDataFrame([(d, "\n".join(r)) for d, r in rows], "doc_id long, text string").repartition(3)
    spans = {r.doc_id: r.spans for r in lines._repeats(docs.selectExpr("doc_id", "text", "cast(null as array<struct<start:long,end:long>>) as spans"), True).collect()}
    texts = {d: "\n".join(r) for d, r in rows}
    first = {d: "\n".join(texts[d][s["start"] : s["end"]] for s in sorted(x, key=lambda s: s["start"])) for d, x in spans.items()}
    assert set(first) == {2, 5} and all(c.startswith("long") and c.count("\n") > 30 for c in first.values())
    got = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    kept = {d: [x for x in r if x.startswith("own")] for d, r in rows}
    assert {d: got[d].strip("\n").split("\n") for d in (2, 4)} == {d: kept[d] for d in (2, 4)} and got[5] == "" and got[1] == texts[1] and got[3] == texts[3]
