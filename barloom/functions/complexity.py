"""Complexity measures of short series, vectorised over Arrow batches.

Each takes an array column of bounded length (a window frame) and returns a double.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def by_length(fn, series: pd.Series, default: float) -> pd.Series:
    """Apply a matrix function to the rows of each distinct length."""
    rows = series.map(lambda v: np.asarray(v if v is not None else [], dtype=float))
    out = np.full(len(series), default)
    lengths = rows.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        if n:
            out[at] = fn(np.stack([rows.iloc[i] for i in at]))
    return pd.Series(out)


def hurst_matrix(x: np.ndarray, min_window: int = 20) -> np.ndarray:
    """Rescaled-range exponent over ten chunk sizes, in [0, 1]; 0.5 when it cannot be fitted."""
    rows, n = x.shape
    half = np.full(rows, 0.5)
    top = n // 4
    if n < 2 * min_window or top < 2:
        return half
    sizes = [min_window + int((top - min_window) * i / 9) for i in range(10)]
    logs, ok = np.zeros((10, rows)), np.zeros((10, rows), bool)
    for i, s in enumerate(sizes):
        k = n // s if s >= 2 else 0
        if not k:
            continue
        c = x[:, : k * s].reshape(rows, k, s)
        dev = c - c.mean(2, keepdims=True)
        walk = dev.cumsum(2)
        spread, sd = walk.max(2) - walk.min(2), np.sqrt((dev**2).mean(2))
        with np.errstate(all="ignore"):
            rs = np.where(sd > 0, spread / np.where(sd > 0, sd, 1), 0).sum(1)
            ok[i] = rs > 0
            logs[i] = np.where(ok[i], np.log(np.where(rs > 0, rs, 1) / k), 0)
    lx = np.log(np.maximum(sizes, 1))[:, None] * ok
    cnt = ok.sum(0)
    with np.errstate(all="ignore"):
        mx, my = lx.sum(0) / cnt, logs.sum(0) / cnt
        dx = np.where(ok, np.log(np.maximum(sizes, 1))[:, None] - mx, 0)
        num, den = (dx * np.where(ok, logs - my, 0)).sum(0), (dx**2).sum(0)
        h = np.clip(num / den, 0, 1)
    return np.where((cnt < 3) | (den == 0), 0.5, h)


def sample_entropy_matrix(x: np.ndarray, m: int = 2, tolerance: float = 0.2) -> np.ndarray:
    """-ln of the ratio of template matches of length m+1 and m; 0 without matches."""
    rows, n = x.shape
    if n < m + 2:
        return np.zeros(rows)
    r = tolerance * x.std(1)

    def rate(k: int) -> tuple[np.ndarray, int]:
        last = n - k
        far = np.zeros((rows, last, last))
        for s in range(k):
            v = x[:, s : s + last]
            far = np.maximum(far, np.abs(v[:, :, None] - v[:, None, :]))
        i, j = np.triu_indices(last, 1)
        return (far[:, i, j] <= r[:, None]).sum(1), len(i)

    (a, ta), (b, tb) = rate(m), rate(m + 1)
    with np.errstate(all="ignore"):
        return np.where((a == 0) | (b == 0), 0.0, -np.log((b / tb) / (a / ta)))


def fluctuation_width_matrix(x: np.ndarray, q_max: float = 2.0, min_window: int = 10) -> np.ndarray:
    """Growth of the fluctuation from one chunk length to four times it, scaled to [0, 1]."""
    rows, n = x.shape
    if n < 4 * min_window:
        return np.zeros(rows)
    power = min(abs(q_max), 2.0)

    def fluct(s: int) -> np.ndarray:
        total = np.zeros(rows)
        for i in range(0, n - s, s):
            c = x[:, i : i + s]
            total += (np.abs(c - c.mean(1, keepdims=True)) ** power).sum(1)
        return total / max(1, n // s)

    long = 4 * min_window
    v1, v2 = fluct(min_window), fluct(long)
    with np.errstate(all="ignore"):
        w = np.abs(np.log(v2 / v1)) / np.log(max(2.0, long / min_window))
    return np.where((v1 < 1e-10) | (v2 < 1e-10), 0.0, np.minimum(1.0, w * 0.1))


@F.pandas_udf(DoubleType())
def _hurst(v: pd.Series) -> pd.Series:
    return by_length(hurst_matrix, v, 0.5)


@F.pandas_udf(DoubleType())
def _entropy(v: pd.Series) -> pd.Series:
    return by_length(sample_entropy_matrix, v, 0.0)


@F.pandas_udf(DoubleType())
def _width(v: pd.Series) -> pd.Series:
    return by_length(fluctuation_width_matrix, v, 0.0)


def hurst(values: Column) -> Column:
    return _hurst(values)


def sample_entropy(values: Column) -> Column:
    return _entropy(values)


def fluctuation_width(values: Column) -> Column:
    return _width(values)
