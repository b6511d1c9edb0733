"""Rolling autoregressions: one-step forecasts from the closes ending at each row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.plans.panel import IDX, KEYS, mapped, windowed

WINDOW, LAGS, FALLBACK_CAP = 120, 5, 0.01


def ar1_forecast(w: WindowSpec, c: str = "close", lagged: str = "_prev", window: int = WINDOW) -> Column:
    """Native AR(1) with constant on the last `window` closes; NULL before the window is full.

    A window without variation falls back to the last close.
    """
    f = w.rowsBetween(-(window - 2), 0)
    fit = F.regr_intercept(c, lagged).over(f) + F.regr_slope(c, lagged).over(f) * F.col(c)
    return F.when(F.count(lagged).over(f) == window - 1, F.coalesce(fit, F.col(c)))


def rolling_ar1(df: DataFrame, window: int = WINDOW, keys: Sequence[str] = KEYS) -> DataFrame:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_prev", F.lag("close").over(w))
        return d.withColumn("ar_forecast", ar1_forecast(w, window=window)).drop("_prev")

    return windowed(df, build, back=window, keys=keys)


def _fit_forecast(y: np.ndarray, window: int, lags: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """AR(lags) forecasts `horizon` steps past each full window of y, all windows solved as one batch."""
    views = np.lib.stride_tricks.sliding_window_view(y, window)
    level = views.mean(axis=1, keepdims=True)
    spread = views.std(axis=1, keepdims=True)
    ok = spread[:, 0] > 1e-12 * np.maximum(1.0, np.abs(level[:, 0]))
    z = (views - level) / np.where(ok[:, None], spread, 1.0)
    target = z[:, lags:]
    design = np.stack([np.ones_like(target)] + [z[:, lags - k : window - k] for k in range(1, lags + 1)], axis=2)
    gram = np.einsum("nti,ntj->nij", design, design)
    right = np.einsum("nti,nt->ni", design, target)
    ok &= np.linalg.cond(gram) < 1e13
    gram[~ok] = np.eye(lags + 1)
    beta = np.linalg.solve(gram, right[:, :, None])[:, :, 0]
    state = z[:, -1 : -lags - 1 : -1].copy()
    for _ in range(horizon):
        step = beta[:, 0] + np.sum(beta[:, 1:] * state, axis=1)
        state = np.concatenate([step[:, None], state[:, :-1]], axis=1)
    value = step * spread[:, 0] + level[:, 0]
    return np.where(ok, value, views[:, -1]), ~ok


def _sliding_fits(y: np.ndarray, x: np.ndarray, window: int, lags: int, x_lags: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts `horizon` rows past every full window, from y's own lags and lags 1..x_lags of the columns of x.

    The normal equations of a window are a difference of two running sums of products, so a row costs one small solve. All
    columns are centred and scaled over the piece first, which keeps the differences well conditioned. Later steps build on
    earlier forecasts and on the last value of x. Windows with a missing value or a singular design fail.
    """
    n, deep = len(y), max(lags, x_lags)
    good = np.isfinite(y) & np.isfinite(x).all(axis=1)
    spread = lambda v: (lambda sd: np.where(sd > 0, sd, 1.0))(np.std(v, axis=0)) if len(v) else np.ones(v.shape[1:])
    mid = lambda v: v.mean(axis=0) if len(v) else np.zeros(v.shape[1:])
    my, sy, mx, sx = mid(y[good]), spread(y[good]), mid(x[good]), spread(x[good])
    z, w = np.where(good, (y - my) / sy, 0.0), np.where(good[:, None], (x - mx) / sx, 0.0)
    lagged = [np.ones(n - deep), *[z[deep - k : n - k] for k in range(1, lags + 1)], *[w[deep - k : n - k, j] for j in range(x.shape[1]) for k in range(1, x_lags + 1)]]
    design = np.column_stack(lagged)
    both = np.column_stack([design, z[deep:]])
    k = design.shape[1]
    running = np.concatenate([np.zeros((1, k + 1, k + 1)), np.cumsum(both[:, :, None] * both[:, None, :], axis=0)])
    sums = running[window - deep :] - running[: len(running) - (window - deep)]  # one for each window's last row
    gram, right, energy = sums[:, :k, :k], sums[:, :k, k], np.sqrt(np.maximum(np.einsum("nii->ni", sums[:, :k, :k]), 1e-300))
    whole = np.cumsum(np.concatenate([[0], ~good]))
    fits = whole[window:] == whole[: len(whole) - window]
    unit = gram / energy[:, :, None] / energy[:, None, :]
    fits &= np.linalg.cond(np.where(fits[:, None, None], unit, np.eye(k))) < 1e11
    unit[~fits] = np.eye(k)
    beta = np.linalg.solve(unit, (right / energy)[:, :, None])[:, :, 0] / energy
    last = np.arange(window - 1, n)
    own = np.column_stack([z[last - i] for i in range(lags)])  # newest first
    others = [np.column_stack([w[last - i, j] for i in range(x_lags)]) for j in range(x.shape[1])]
    for _ in range(horizon):
        step = np.einsum("nk,nk->n", beta, np.column_stack([np.ones(len(last)), own, *others]))
        own = np.column_stack([step, own])[:, :lags]
        others = [np.column_stack([o[:, :1], o])[:, :x_lags] for o in others]
    return np.where(fits, step * sy + my, np.nan), ~fits


def rolling_fit_predict(
    df: DataFrame, value: str = "close", window: int = 252, lags: int = LAGS, horizon: int = 1,
    out: str = "ar_forecast", keys: Sequence[str] = KEYS, size: int | None = None,
    regressors: Sequence[str] = (), x_lags: int = 1, on_failure: str = "null",
) -> DataFrame:
    """At each row, refit AR(lags) on the last `window` values and forecast `horizon` rows ahead; with `regressors`, their
    lags 1..x_lags join the fit.

    Adds `out`, `is_fallback` and `target_idx` (the row position the forecast is for). Windows are
    cut inside haloed chunks, so no array of past values is shuffled per row. Where a fit fails, the forecast is NULL, or
    the window's last value with on_failure="last".
    """
    if on_failure not in ("null", "last"):
        raise ValueError("on_failure is 'null' or 'last'")
    if window <= max(lags, x_lags if regressors else 0) + 1 + lags + len(regressors) * x_lags:
        raise ValueError("the window holds too few rows for these lags")
    schema = T.StructType(
        [*df.schema.fields, T.StructField(out, T.DoubleType()), T.StructField("is_fallback", T.BooleanType()),
         T.StructField("target_idx", T.LongType())]
    )
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf[value].to_numpy(dtype=float), pdf[[*regressors]].to_numpy(dtype=float)
        forecast, failed = np.full(len(y), np.nan), np.zeros(len(y), dtype=bool)
        for lo in range(0, max(len(y) - window + 1, 0), 1024):
            part = y[lo : lo + window - 1 + 1024]
            hi = lo + len(part)
            fit = _sliding_fits(part, x[lo:hi], window, lags, x_lags, horizon) if regressors else _fit_forecast(part, window, lags, horizon)
            forecast[lo + window - 1 : hi], failed[lo + window - 1 : hi] = fit
        if on_failure == "null":
            forecast[failed] = np.nan
        elif regressors:
            forecast = np.where(failed, y, forecast)
        pdf[out] = pd.Series(forecast).astype(object).where(~np.isnan(forecast), None)
        pdf["is_fallback"] = failed
        pdf["target_idx"] = pdf[IDX] + horizon
        return pdf.loc[pdf["_owned"], names]

    return mapped(df, run, schema, back=window - 1, keys=keys, size=size)


def rolling_ar(df: DataFrame, window: int = WINDOW, lags: int = LAGS, keys: Sequence[str] = KEYS, size: int | None = None) -> DataFrame:
    """Forecast of the next close from the last 120 closes; the newest row gets one too."""
    return rolling_fit_predict(df, "close", window, lags, 1, "ar_forecast", keys, size, on_failure="last")


def fallback_share(df: DataFrame, by: Sequence[str] = KEYS, cap: float = FALLBACK_CAP) -> DataFrame:
    """Attempted and failed fits per key, and whether the share stays within the cap."""
    n, bad = F.count("ar_forecast"), F.count_if(F.col("is_fallback"))
    return df.groupBy(*by).agg(n.alias("attempted"), bad.alias("fallbacks"), (bad <= cap * n).alias("within_cap"))


def require_within_cap(df: DataFrame, by: Sequence[str] = KEYS, cap: float = FALLBACK_CAP) -> None:
    """Raise when any key has too many fallback fits (one small action)."""
    worst = fallback_share(df, by, cap).filter("NOT within_cap").limit(1).collect()
    if worst:
        raise RuntimeError(f"too many AR fits failed: {worst[0].asDict()}")
