"""Tail probabilities on small aggregated results (NumPy, vectorised), as Arrow pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if np.nanmax(np.abs(step - 1.0), initial=0.0) < 1e-15:
            return h
    raise ArithmeticError("the incomplete beta fraction did not settle")


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = (np.atleast_1d(np.asarray(v, dtype=float)) for v in np.broadcast_arrays(a, b, x))
    inner = np.clip(x, _TINY, 1.0 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    flip = inner > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - inner, inner)
    part = front * _fraction(aa, bb, xx) / aa
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(flip, 1.0 - part, part)))


def student_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def binomial_greater(k, n) -> np.ndarray:
    """P(X >= k) for X ~ Binomial(n, 1/2)."""
    k, n = np.asarray(k, dtype=float), np.asarray(n, dtype=float)
    return np.where(k <= 0, 1.0, betainc(np.maximum(k, 1.0), n - k + 1.0, 0.5))


def binomial_two_sided(k, n) -> np.ndarray:
    """Exact two-sided test against one half (symmetric, so twice the smaller tail)."""
    k, n = np.asarray(k, dtype=float), np.asarray(n, dtype=float)
    return np.minimum(1.0, 2.0 * binomial_greater(np.maximum(k, n - k), n))


def clopper_pearson(k, n, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Exact interval by bisection on the incomplete beta function."""
    k, n = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (k, n))
    tail = (1.0 - level) / 2.0

    def solve(a, b, target):
        lo, hi = np.zeros_like(k), np.ones_like(k)
        for _ in range(80):
            mid = (lo + hi) / 2.0
            below = betainc(a, b, mid) < target
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return (lo + hi) / 2.0

    low = np.where(k <= 0, 0.0, solve(np.maximum(k, 1.0), n - k + 1.0, tail))
    high = np.where(k >= n, 1.0, solve(k + 1.0, np.maximum(n - k, 1.0), 1.0 - tail))
    return low, high


def kolmogorov_tail(d, n) -> np.ndarray:
    """Asymptotic two-sided Kolmogorov-Smirnov p-value with the usual small-sample shift."""
    d, n = np.asarray(d, dtype=float), np.asarray(n, dtype=float)
    root = np.sqrt(n)
    lam = (root + 0.12 + 0.11 / root) * d
    j = np.arange(1, 101)[:, None]
    alternating = 2.0 * np.sum((-1.0) ** (j - 1) * np.exp(-2.0 * j**2 * lam[None, :] ** 2), axis=0)
    return np.where(lam < 0.2, 1.0, np.clip(alternating, 0.0, 1.0))


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_two_sided(t, df))


@F.pandas_udf(T.DoubleType())
def kolmogorov_p(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(kolmogorov_tail(d.to_numpy(float), n.to_numpy(float)))


_BINOMIAL = T.StructType([T.StructField(c, T.DoubleType()) for c in ("p_two_sided", "p_greater", "ci_low", "ci_high")])


@F.pandas_udf(_BINOMIAL)
def binomial_p(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    low, high = clopper_pearson(k, n)
    return pd.DataFrame(
        {"p_two_sided": binomial_two_sided(k, n), "p_greater": binomial_greater(k, n), "ci_low": low, "ci_high": high}
    )
