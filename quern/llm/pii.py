"""Operator 8: personal data in plain and disguised form, with offsets into the source text.

Base spans: leftmost matches that don't overlap, by kind, on the text as it is. Added spans: transducers rewrite
homoglyphs, invisible characters, spelled digits and at/dot disguises, and keep for each rewritten piece where it came
from; the same detectors run on the rewritten text, and what they find across a rewritten piece is mapped back.

Null texts count as empty: no spans. Repeated rows and ids are scanned each on their own; an empty table gives an empty
result; other columns don't matter, whatever their names. Texts may have any length: detectors and transducers are anchored
(on @ or a word for it, on brackets, on digit words, on the first digit of a run, on +) and look at each gap between two
anchors once, so the time is linear in it. A disguised address reaches REACH characters to either side of its sign at most,
more than the longest that is valid (64 and 253). No shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.runtime import ship

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+", re.A)
_LOCAL_BACK = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Any ip, card or phone holds this.
_NUMERIC = re.compile(r"[0-9][\x20().0-9-]{6}")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str):
    """Every @ has one match at most: what local characters stand before it (from the last match's end on) and a dotted domain after it."""
    at, least = text.find("@"), 0
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL_BACK:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            least = m.end()
        at = text.find("@", max(at + 1, least))


def luhn(digits: list[str]) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def found(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _NUMERIC.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() and 16 <= len(d := _DIGITS.findall(m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


#: Letters of other scripts that look like Latin ones, in pairs.
HOMOGLYPHS = dict(zip("АВЕКМНОРСТУХІЈЅаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρυι", "ABEKMHOPCTYXIJSaeopcyxijsdqwhABEZHIKMNOPTYXaovpui", strict=True))
#: Full-width ASCII, mathematical digits, and digits of other scripts; signs that stand for @ . + -
HOMOGLYPHS |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
HOMOGLYPHS |= {chr(0x1D7CE + k): str(k % 10) for k in range(50)}
HOMOGLYPHS |= {chr(zero + k): str(k) for zero in (0x0660, 0x06F0, 0x0966, 0x09E6) for k in range(10)}
HOMOGLYPHS |= {"﹫": "@", "．": ".", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "＋": "+", " ": " ", " ": " ", " ": " "}
INVISIBLE = "­​‌‍⁠﻿"
_GLYPH = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + INVISIBLE + "]+")
#: What makes a text worth rewriting; no-break spaces and dashes alone don't.
_ODD = re.compile("[" + re.escape("".join(c for c in HOMOGLYPHS if c not in "–‐‑‒−   ")) + INVISIBLE + "]|[0-9][–‐‑‒−   ][0-9]")
_MAP = str.maketrans(HOMOGLYPHS | dict.fromkeys(INVISIBLE))

#: Spelled digits of English, French, German and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SPELLED = "|".join(sorted(SPELLED, key=len, reverse=True))
_POINT = r"dot|point|punkt|punto|period"
_WORD = re.compile(rf"(?<!\w)(?:{_SPELLED})(?!\w)", re.I)
_MANY = re.compile(r"(?<!\w)(?:double|triple)[\s-]{1,3}\Z", re.I)
#: What may stand between two digit words of one run: points, signs, numerals.
_STEP = rf"(?:\s+(?:{_POINT})\s+|[\s,-]{{1,3}}|\.)"
_GAP = re.compile(rf"{_STEP}(?:(?:[0-9]+|double|triple){_STEP})*", re.I)
#: Characters that a disguised address may have on either side of its sign.
REACH = 330
_PLUS = re.compile(r"(?<!\w)plus[\s-]+(?=\+?[0-9])", re.I)
_BRACKET = re.compile(rf"[\[({{<]\s*(?:(?P<at>at|@|arroba|chez|ät)|(?P<dot>{_POINT}|\.)|(?P<dash>dash|hyphen|-))\s*[\])}}>]", re.I)
_DOT = rf"(?:\s+(?:{_POINT})\s+|[_-]dot[_-])"
#: Around the sign of an address with a spelled dot: what ends before it, and what begins after it.
_BEFORE_AT = re.compile(rf"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{{1,64}}(?:\s+(?:{_POINT})\s+[A-Za-z0-9_%+-]{{1,64}})*\Z", re.I)
_AFTER_AT = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}|\s*\.\s*)[A-Za-z0-9-]{{1,63}})*?{_DOT}(?!(?:and|the|or|of|to|in|is|it|at|an|as|dot)\b)[A-Za-z]{{2,24}}(?:\s+(?:{_POINT})\s+[A-Za-z]{{2,24}})*(?![A-Za-z0-9])", re.I)
_SIGN = re.compile(r"\s+at\s+|[_-]at[_-]|\s+arroba\s+|\s*@\s*", re.I)
#: Disguises of the @ alone, before a domain with plain dots; a spelled one only where the whole stands for an address.
_AT_ONLY = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-](?P<at>\s+@\s*|\s*@\s+|\s+(?:at|arroba|chez|ät)\s+|[_-]at[_-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])", re.I)
_BARE_DOT = re.compile(rf"\s+(?:{_POINT})\s+|[_-]dot[_-]|\s*\.\s*", re.I)
_BARE_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:\s+(?:{_POINT})\s+[0-9]{{1,3}}){{3}}(?![0-9])", re.I)


class Rewritten:
    """A text under rewriting: cuts[k] = (start here, start in the source, end in the source) of each rewritten piece."""

    def __init__(self, text: str):
        self.text, self.cuts = text, []

    def source(self, at: int, end: bool) -> int:
        """Where a position here lies in the source; inside a rewritten piece, the piece's start or end."""
        k = bisect_right(self.cuts, at - end, key=lambda c: c[0]) - 1
        if k < 0:
            return at
        here, length, a, b = self.cuts[k]
        if at - end < here + length:
            return b if end else a
        return b + at - (here + length)

    def touched(self, a: int, b: int) -> bool:
        """Whether a rewritten piece lies in or next to the stretch."""
        k = bisect_right(self.cuts, b, key=lambda c: c[0]) - 1
        return k >= 0 and self.cuts[k][0] + self.cuts[k][1] >= a

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings for stretches, given from left to right without overlap."""
        edits = [e for e in edits if self.text[e[0] : e[1]] != e[2]]
        if not edits:
            return
        parts, cuts, at, shift = [], [], 0, 0
        new = [(a + 0, b, s, self.source(a, False), self.source(b, True) if b > a else self.source(a, False)) for a, b, s in edits]
        old = self.cuts
        k = 0
        for a, b, s, x, y in new:
            while k < len(old) and old[k][0] + old[k][1] <= a:  # earlier pieces stay, further right or left
                cuts.append((old[k][0] + shift, *old[k][1:]))
                k += 1
            while k < len(old) and old[k][0] < b:  # what the edit covers becomes part of it
                x, y = min(x, old[k][2]), max(y, old[k][3])
                k += 1
            parts += [self.text[at:a], s]
            cuts.append((a + shift, len(s), x, y))
            shift += len(s) - (b - a)
            at = b
        cuts += [(c[0] + shift, *c[1:]) for c in old[k:]]
        self.text, self.cuts = "".join([*parts, self.text[at:]]), cuts


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of three or more spelled digits (with numerals between them) as numerals."""
    edits, runs = [], []
    for m in _WORD.finditer(text):
        if runs and _GAP.fullmatch(text, runs[-1][-1].end(), m.start()):
            runs[-1].append(m)
        else:
            runs.append([m])
    for run in runs:
        last = None
        for m in run if len(run) >= 3 else ():
            many = _MANY.search(text, max(last or 0, m.start() - 12), m.start())
            a = many.start() if many else m.start()
            if last is not None and not text[last:a].strip(" \t\n\r\x0b\x0c,-"):
                a = last  # the separator goes with it
            edits.append((a, m.end(), SPELLED[m[0].lower()] * (1 if not many else 2 if many[0].lower().startswith("d") else 3)))
            last = m.end()
    return edits


def _bracket_edits(text: str) -> list[tuple[int, int, str]]:
    """Bracketed signs, with the white space around them."""
    edits, least = [], 0
    for m in _BRACKET.finditer(text):
        a, b = m.span()
        while a > least and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        edits.append((a, b, "@" if m["at"] else "." if m["dot"] else "-"))
        least = b
    return edits


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    """Addresses with a spelled dot, around each word or sign for @."""
    edits, least = [], 0
    for sign in _SIGN.finditer(text):
        a, b = sign.span()
        if a < least:
            continue
        before = _BEFORE_AT.search(text, max(least, a - REACH), a)
        after = before and _AFTER_AT.match(text, b, b + REACH)
        if after:
            dots = [(*d.span(), ".") for x, y in ((before.start(), a), (b, after.end())) for d in _BARE_DOT.finditer(text, x, y)]
            edits += sorted([(a, b, "@"), *dots])
            least = after.end()
    return edits


def rewritten(text: str) -> Rewritten | None:
    """The text through all transducers; None if none of them has anything to do."""
    low, out = text.lower(), Rewritten(text)
    if not text.isascii() and _ODD.search(text):
        out.rewrite([(m.start() + k, m.start() + k + 1, c.translate(_MAP)) for m in _GLYPH.finditer(text) for k, c in enumerate(m[0])])
        low = out.text.lower()
    if edits := _digit_edits(out.text):
        out.rewrite(edits)
        out.rewrite([(*m.span(), "+") for m in _PLUS.finditer(out.text)])
    if "[" in text or "(" in text or "{" in text or "<" in text:
        out.rewrite(_bracket_edits(out.text))
    if "." in low and ("@" in low or "at" in low or "arroba" in low or "chez" in low or "ät" in low):
        out.rewrite([(*m.span("at"), "@") for m in _AT_ONLY.finditer(out.text)])
    if any(w in low for w in ("dot", "point", "punkt", "punto", "period")):
        out.rewrite(_address_edits(out.text))
        out.rewrite([(*d.span(), ".") for m in _BARE_IP.finditer(out.text) for d in _BARE_DOT.finditer(out.text, *m.span())])
    return out if out.cuts else None


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans)."""
    base, new = found(text), rewritten(text)
    if new is None:
        return base, []
    have, added = {}, set()
    for k, a, b in base:
        have.setdefault(k, []).append((a, b))
    for k, a, b in found(new.text):
        if new.touched(a, b):
            x, y = new.source(a, False), new.source(b, True)
            if not any(p <= x and y <= q for p, q in have.get(k, [])):
                added.add((k, x, y))
    return base, sorted(added)


def _joined(found_spans) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in found_spans])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document; the numbers count base spans."""
    ship(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def batches(it):
        for b in it:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                rows = []
                for t in part.column(1).to_pylist():
                    base, added = spans(t or "")
                    rows.append((*(sum(x[0] == k for x in base) for k in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added))))
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([part.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4]), pa.array(cols[5])], names=names)

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
