"""Cross-moment matrices of lagged columns: one distributed pass, any number of small solves.

Every least-squares job on a panel (unit-root tests, AR / ARMA / ARDL orders, error correction)
needs only sums of products of lagged values. Chunks add up their own products; the sums combine
map-side per key. No task ever holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.plans.attach import attach
from barloom.plans.panel import IDX, KEYS, mapped


def sum_arrays(df: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """Element-wise sum of an array column per key, combined map-side."""
    return df.groupBy(*by).agg(Summarizer.sum(array_to_vector(c)).alias(c)).withColumn(c, vector_to_array(c))


def standardise(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, where: Column | None = None) -> DataFrame:
    """Adds z_<c>, mean_<c>, sd_<c>: columns centred and scaled per key, which keeps the sums well conditioned."""
    base = df.filter(where) if where is not None else df
    aggs = [a for c in cols for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"sd_{c}"))]
    out = attach(df, base.groupBy(*keys).agg(*aggs), keys, "left")
    return out.withColumns({f"z_{c}": (F.col(c) - F.col(f"mean_{c}")) / F.coalesce(F.nullif(f"sd_{c}", F.lit(0.0)), F.lit(1.0)) for c in cols})


def _carry_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def lag_moments(
    df: DataFrame, cols: Sequence[str], max_lag: int, keys: Sequence[str] = KEYS, lag_col: str | None = None,
    segment: str | None = None, n_segments: int = 1, size: int | None = None,
) -> DataFrame:
    """keys, [segment], moments: flattened G = sum of v v' over rows with a full set of lags, with
    v = (1, c1[t], c1[t-1] .. c1[t-L], c2[t], ...).

    lag_col: per-key L (at most max_lag). segment: an integer s in 1..n_segments; the matrix of segment
    k sums the rows with s <= k, so nested training windows need one pass. NULL segments are left out.
    """
    keys, cols = list(keys), list(cols)
    extra = [c for c in (lag_col, segment) if c]
    fields = _carry_fields(df, keys) + [T.StructField("segment", T.IntegerType()), T.StructField("moments", T.ArrayType(T.DoubleType()))]
    names = [f.name for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lag = int(pdf[lag_col].iloc[0]) if lag_col else max_lag
        values, n = [pdf[c].to_numpy(dtype=float) for c in cols], len(pdf)
        rows = np.flatnonzero(pdf["_owned"].to_numpy() & (pdf[IDX].to_numpy() >= lag))
        if lag < 0 or n <= lag or len(rows) == 0:
            return pd.DataFrame(columns=names)
        seg = pdf[segment].to_numpy(dtype=float)[rows] if segment else np.ones(len(rows))
        out = []
        for s in np.unique(seg[~np.isnan(seg)]):
            total = 0.0
            pick = rows[seg == s]
            for lo in range(0, len(pick), 4096):
                at = pick[lo : lo + 4096]
                v = np.column_stack([np.ones(len(at))] + [c[at - k] for c in values for k in range(lag + 1)])
                v = v[np.isfinite(v).all(axis=1)]
                total = total + v.T @ v
            out.append([*[pdf[k].iloc[0] for k in keys], int(s), total.ravel()])
        return pd.DataFrame(out, columns=names)

    part = mapped(df.select(*keys, IDX, *cols, *extra), run, T.StructType(fields), back=max(max_lag, 1), keys=keys, size=size)
    if not segment:
        return sum_arrays(part.drop("segment"), keys, "moments")
    upto = part.withColumn("segment", F.explode(F.sequence("segment", F.lit(n_segments))))
    return sum_arrays(upto, [*keys, "segment"], "moments")


def lag_products(df: DataFrame, c: str, max_lag: int, keys: Sequence[str] = KEYS, lag_col: str | None = None, size: int | None = None) -> DataFrame:
    """keys, products: sum over t of c[t] c[t-k] for k = 0..L."""
    keys = list(keys)
    fields = _carry_fields(df, keys) + [T.StructField("products", T.ArrayType(T.DoubleType()))]
    names = [f.name for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lag = int(pdf[lag_col].iloc[0]) if lag_col else max_lag
        y, mine = pdf[c].to_numpy(dtype=float), pdf["_owned"].to_numpy()
        if not mine.any():
            return pd.DataFrame(columns=names)
        padded, at = np.concatenate([np.zeros(lag), y]), np.flatnonzero(mine) + lag
        sums = np.array([padded[at] @ padded[at - k] for k in range(lag + 1)])
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], sums]], columns=names)

    cols = [*keys, IDX, c, *([lag_col] if lag_col else [])]
    return sum_arrays(mapped(df.select(*cols), run, T.StructType(fields), back=max(max_lag, 1), keys=keys, size=size), keys, "products")


class Moments:
    """A cross-moment matrix with named rows; least squares on any subset or linear mix of them."""

    def __init__(self, flat, names: Sequence[str]):
        k = len(names)
        self.g = np.asarray(flat, dtype=float).reshape(k, k)
        self.names = list(names)

    @property
    def n(self) -> float:
        return self.g[0, 0]

    def mix(self, rows: dict[str, dict[str, float]]) -> "Moments":
        """New matrix whose variables are linear combinations of the current ones."""
        at = {name: i for i, name in enumerate(self.names)}
        t = np.zeros((len(rows), len(self.names)))
        for r, combo in enumerate(rows.values()):
            for name, weight in combo.items():
                t[r, at[name]] += weight
        return Moments((t @ self.g @ t.T).ravel(), list(rows))

    def plus(self, vectors: np.ndarray) -> "Moments":
        return Moments((self.g + vectors.T @ vectors).ravel(), self.names)

    def ols(self, y: str, x: Sequence[str]) -> tuple[np.ndarray, float, np.ndarray]:
        """(coefficients, residual sum of squares, inverse moment matrix); raises on a singular design."""
        at = [self.names.index(c) for c in x]
        iy = self.names.index(y)
        xx, xy = self.g[np.ix_(at, at)], self.g[at, iy]
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        unit = xx / np.outer(scale, scale)
        if np.linalg.cond(unit) > 1e13:
            raise np.linalg.LinAlgError("singular design")
        inverse = np.linalg.inv(unit) / np.outer(scale, scale)
        beta = inverse @ xy
        return beta, max(float(self.g[iy, iy] - beta @ xy), 1e-300), inverse


def lag_names(cols: Sequence[str], lag: int) -> list[str]:
    return ["1"] + [f"{c}{k}" for c in cols for k in range(lag + 1)]


def gaussian_llf(n: float, ssr: float) -> float:
    return -n / 2.0 * (np.log(2.0 * np.pi) + np.log(ssr / n) + 1.0)
