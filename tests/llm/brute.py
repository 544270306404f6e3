"""Plain versions of the contracts, row by row, to hold the operators against."""

import hashlib
import re
from collections import defaultdict

sha = lambda x: hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = "one two three four five six seven eight nine ten " * 12
DOCS = [
    (-1, None, "en", "s", None), (-2, "", "en", None, 0), (-3, "a " * 19, "en", "s", 1), (-4, "a " * 40, None, "s", 1), (-5, LONG, "en", "s", 1), (-6, LONG + " x", "en", "s", 1),
    (-7, "é\x1c\xa0 b\x0b" * 30, "fr", "s", 1), (-8, "a b", "en", "s", 1), (-9, "A  b", "en", "s", 1), (-10, "a\nb\n\n\na\nb", "en", "s", 1), (-11, "\n\n", "zz", "s", 1),
    (-12, "x" * 50_000, "en", "s", 1), (-13, ("word " * 7 + "\n") * 3000, "en", "s", 1), (None, LONG, "en", "s", 1),
]


def substrings(docs, size=20):
    first, late, words = {}, defaultdict(list), {}
    for d, t in sorted(docs):
        words[d] = WORD.findall(t or "")
        for i in range(len(words[d]) - size + 1):
            key = tuple(words[d][i : i + size])
            if first.setdefault(key, (d, i)) != (d, i):
                late[d].append(i)
    out = {}
    for d, w in words.items():
        keep = [True] * len(w)
        for i in late[d]:
            keep[i : i + size] = [False] * size
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out[d] = (len(w), len(w) - len(kept), sha(" ".join(kept)))
    return out


def near(docs, shingle=4):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where, met = defaultdict(list), defaultdict(int)
    for d in sorted(sets):
        for s in sets[d]:
            for e in where[s]:
                met[e, d] += 1
            where[s].append(d)
    for (a, b), n in met.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def secrets(t):
    t, found = t or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        found += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    names = ["assign", "access", "hex"]
    return [sum(k == x for _, x, _ in found) for k in range(3)], sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found)))


def pii(t):
    t = t or ""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
        out += [(2, *m.span())] * (16 <= len(d) <= 19 and total % 10 == 0)
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out
