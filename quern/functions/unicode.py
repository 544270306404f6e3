"""The functions that Spark lacks: Jaro-Winkler similarity and Unicode name normalisation, as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


def jaro(a: str, b: str) -> float:
    """Jaro similarity; half transpositions count as halves."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    common_a = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            common_a.append(c)
    if not common_a:
        return 0.0
    common_b = [c for c, unused in zip(b, free, strict=True) if not unused]
    m = len(common_a)
    swapped = sum(x != y for x, y in zip(common_a, common_b, strict=True))
    return (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3.0


def jaro_winkler_score(a: str, b: str) -> float:
    """Jaro with a bonus of a tenth for each of up to four common first letters, from 0.7 on."""
    score = jaro(a, b)
    if score < 0.7:
        return score
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return score + 0.1 * same * (1.0 - score)


def _scores(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else jaro_winkler_score(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def _normal(names: pa.Array) -> pa.Array:
    return pa.array([re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", x or "").casefold()).strip() for x in names.to_pylist()], pa.string())


def jaro_winkler(a: Column, b: Column) -> Column:
    return arrow_udf(_scores, "double")(a, b)


def normal_name_exact(name: Column) -> Column:
    """NFKC, case folding, and runs of other characters than letters and digits to one space."""
    return arrow_udf(_normal, "string")(name)
