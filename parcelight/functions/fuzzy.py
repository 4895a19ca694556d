"""Fuzzy string scores: indel similarity, its windowed and token forms, as Arrow UDFs over distinct pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & ((1 << len(a)) - 1)).bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths; two empty strings are equal."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def token_ratio(a: str, b: str, partial: bool = False) -> float:
    """The better of sorted tokens and of common tokens against each side's own."""
    x, y = sorted(a.split()), sorted(b.split())
    score = partial_ratio if partial else ratio
    best = score(" ".join(x), " ".join(y))
    both = sorted(set(x) & set(y))
    left, right = sorted(set(x) - set(y)), sorted(set(y) - set(x))
    if both and (not left or not right or partial):
        return 100.0
    common, one, two = " ".join(both), " ".join(both + left), " ".join(both + right)
    return max(best, score(one, two), *((ratio(common, one), ratio(common, two)) if both else ()))


def weighted_ratio(a: str, b: str) -> float:
    """The best of plain, partial and token scores, the looser ones scaled down as lengths differ."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if lengths < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * token_ratio(a, b, partial=True))


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x or "", y or "") for x, y in zip(a, b)])
