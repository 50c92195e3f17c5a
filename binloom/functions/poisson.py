"""Central Poisson interval for a count, through the gamma quantile.

Only the bins of a histogram reach this pandas function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

COVERAGE = 0.6827


def _lower_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x), a >= 1, by series or continued fraction."""
    out = np.zeros_like(x)
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - np.array([math.lgamma(v) for v in a]))
    small = x < a + 1
    term, total = 1 / a, 1 / a
    for k in range(1, 20_000):
        term = term * x / (a + k)
        total = total + term
        if np.all(~small | (term < total * 1e-15)):
            break
    out[small] = (front * total)[small]
    b, c, d = x + 1 - a, np.full_like(x, 1e300), 1 / np.where(small, 1.0, x + 1 - a)
    h = d
    for k in range(1, 20_000):
        an = -k * (k - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = b + an / c
        h, last = h * d * c, h
        if np.all(small | (np.abs(h - last) < np.abs(h) * 1e-14)):
            break
    out[~small] = (1 - front * h)[~small]
    return out


def gamma_quantile(p: float, a: np.ndarray) -> np.ndarray:
    """x with P(a, x) = p, by bisection between safe bounds."""
    a = np.asarray(a, dtype=float)
    width = 12 * np.sqrt(a) + 20
    lo, hi = np.maximum(a - width, 0.0), a + width
    for _ in range(100):
        mid = (lo + hi) / 2
        below = _lower_tail(a, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def interval(n: pd.Series) -> pd.DataFrame:
    tail = (1 - COVERAGE) / 2
    v = n.to_numpy(dtype=float)
    with np.errstate(all="ignore"):
        low = np.where(v > 0, gamma_quantile(tail, np.maximum(v, 1.0)), 0.0)
        high = gamma_quantile(1 - tail, v + 1)
    return pd.DataFrame({"low": low, "high": high})


def poisson_interval(counts: DataFrame, n: str) -> DataFrame:
    """Adds the asymmetric errors of each count; the rows are bins, so there are few of them."""
    bounds = F.pandas_udf(interval, "low double, high double")
    return counts.withColumn("__b", bounds(F.col(n))).select(
        *counts.columns, (F.col(n) - F.col("__b.low")).alias("err_down"), (F.col("__b.high") - F.col(n)).alias("err_up"))
