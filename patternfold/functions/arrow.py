"""Column functions that need a loop per row: Arrow-batched Python."""

from __future__ import annotations

import difflib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=128)
def dtw(a: tuple[float, ...], b: tuple[float, ...], window: int | None = None) -> tuple[float, tuple[tuple[int, int], ...]]:
    """Dynamic time warping with absolute cost in a band of ``window``: distance, and the path (diagonal steps first)."""
    n, m = len(a), len(b)
    if not n or not m or any(x is None or x != x for x in (*a, *b)):
        raise ValueError("series must not be empty or hold missing numbers")
    if window is not None and window < abs(n - m):
        raise ValueError("window is narrower than the difference in length")
    w = max(n, m) if window is None else window
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    y = np.asarray(b, float)
    for i in range(1, n + 1):
        low, high = max(1, i - w), min(m, i + w)
        d = np.abs(a[i - 1] - y[low - 1 : high])
        above = np.minimum(cost[i - 1, low - 1 : high], cost[i - 1, low : high + 1])
        left = cost[i, low - 1]
        for j, (c, up) in enumerate(zip(d.tolist(), above.tolist()), low):
            left = c + min(up, left)
            cost[i, j] = left
    path, i, j = [], n, m
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: cost[p])
    return float(cost[n, m]), tuple(reversed(path))


def dtw_whole(a, b) -> float:
    """The distance of ``dtw`` without a band or a path, by diagonals: three of them are held, so long series fit."""
    x, y = sorted((np.asarray(a, float), np.asarray(b, float)), key=len)
    n, m = len(x), len(y)
    if not n or np.isnan(x).any() or np.isnan(y).any():
        raise ValueError("series must not be empty or hold missing numbers")
    y = y[::-1].copy()
    before, last, now = (np.full(n + 1, np.inf) for _ in range(3))  # by place in x, 0 before its first
    before[0] = 0
    for k in range(2, n + m + 1):
        low, high = max(1, k - m), min(n, k - 1)
        best = np.minimum(last[low - 1 : high], last[low : high + 1])
        np.minimum(best, before[low - 1 : high], out=best)
        cost = now[low : high + 1]
        np.subtract(x[low - 1 : high], y[m - k + low : m - k + high + 1], out=cost)
        np.abs(cost, out=cost)
        cost += best
        before[0] = np.inf
        before, last, now = last, now, before
    return float(last[n])


@F.pandas_udf(T.DoubleType())
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([dtw_whole(x, y) for x, y in zip(a, b)])


def dtw_distance_in(window: int):
    """dtw_distance within a band."""

    @F.pandas_udf(T.DoubleType())
    def banded(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dtw(tuple(x), tuple(y), window)[0] for x, y in zip(a, b)])

    return banded


_STEP = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])


@F.pandas_udf(T.ArrayType(_STEP))
def dtw_path(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"i": i, "j": j} for i, j in dtw(tuple(x), tuple(y))[1]] for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks' share of both sequences; 1 if both are empty, 0 if one is."""
    return pd.Series([1.0 if not len(x) and not len(y) else 0.0 if not len(x) or not len(y) else difflib.SequenceMatcher(None, list(x), list(y)).ratio() for x, y in zip(a, b)])
