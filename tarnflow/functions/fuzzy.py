"""String similarity by longest common subsequence, as Arrow functions over distinct pairs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel: one big-integer step per character of b."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one of its length, windows at the ends cut short."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)) if long[max(0, i) : i + n])


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words with either rest."""
    x, y = set(re.split(r"\s+", a.strip())) - {""}, set(re.split(r"\s+", b.strip())) - {""}
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([ratio(first, second)] + ([ratio(both, first), ratio(both, second)] if both else []))


def similarity(a: Column, b: Column, kind: str = "ratio") -> Column:
    """0 to 100; null where a side is null. kind: ratio, partial_ratio or token_set_ratio."""
    one = {"ratio": ratio, "partial_ratio": partial_ratio, "token_set_ratio": token_set_ratio}[kind]

    def many(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p, q) if isinstance(p, str) and isinstance(q, str) else None for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(many, "double")(a, b)
