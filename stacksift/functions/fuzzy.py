"""Longest-common-subsequence ratios of token texts, as pandas UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        m = s & where.get(c, 0)
        s = (s + m | s - m) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (len a + len b); 100 for two empty texts."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    """`ratio` of the words in order of the alphabet."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best `ratio` among the common words and each side's whole; 0 if a side is empty, 100 if one holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_a, only_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    left, right = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max(ratio(left, right), ratio(both, left), ratio(both, right)) if both else ratio(left, right)


def ratio_column(f):
    """A pandas UDF of one of the ratios; null counts as ''."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return of
