"""Distribution tails, as vectorised Arrow functions (no scientific library is needed)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _tail(k: int, last: int, mode: int, log_at, ratio) -> float:
    """Sum of a unimodal distribution over k..last: from the largest term outwards until terms vanish.

    ratio(i) is p(i + 1) / p(i). Far below the mode the complement is summed instead.
    """
    if k > last:
        return 0.0

    def run(start: int, stop: int, step: int) -> float:
        total, term, i = 0.0, 1.0, start
        while True:
            total += term
            if i == stop:
                break
            term = term * ratio(i) if step > 0 else term / ratio(i - 1)
            i += step
            if term < total * 1e-17:
                break
        return math.exp(log_at(start)) * total

    if k > mode:
        return min(1.0, run(k, last, 1))
    return min(1.0, max(0.0, 1.0 - run(k - 1, 0, -1))) if k > 0 else 1.0


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X >= k) of n trials with probability p."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    choose = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
    log_at = lambda i: choose(i) + i * math.log(p) + (n - i) * math.log1p(-p)
    return _tail(k, n, int((n + 1) * p), log_at, lambda i: (n - i) / (i + 1) * p / (1 - p))


def hypergeometric_sf(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k) marked ones among `drawn` of `total`, of which `marked` are marked."""
    low, high = max(0, drawn + marked - total), min(marked, drawn)
    if k <= low:
        return 1.0
    if k > high:
        return 0.0
    ln = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    log_at = lambda i: ln(marked, i + low) + ln(total - marked, drawn - i - low) - ln(total, drawn)
    ratio = lambda i: (marked - i - low) * (drawn - i - low) / ((i + low + 1) * (total - marked - drawn + i + low + 1))
    mode = (drawn + 1) * (marked + 1) // (total + 2)
    return _tail(k - low, high - low, mode - low, log_at, ratio)


@F.pandas_udf(T.DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return z.map(normal_tail)


@F.pandas_udf(T.DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_sf(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_sf(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, total, marked, drawn, strict=True)], dtype=float)


def storey_weights(grid: np.ndarray) -> np.ndarray:
    """What the least-squares cubic through values on the grid gives at its end, as weights of the values."""
    vandermonde = np.vander(grid, 4)
    return vandermonde[-1] @ np.linalg.pinv(vandermonde)
