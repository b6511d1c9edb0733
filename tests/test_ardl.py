"""ARDL trends, causal lags, given futures and rolling regressions, against plain least squares."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import econometrics as eco, rolling
from barloom.plans.panel import row_index

RNG = np.random.default_rng(11)
X = np.cumsum(RNG.normal(size=260)) + 20
Y = np.zeros(260)
for _t in range(1, 260):
    Y[_t] = 3 + 0.02 * _t + 0.5 * Y[_t - 1] + 0.8 * X[_t - 1] + 0.3 * RNG.normal()


@pytest.fixture(scope="module")
def series(spark):
    pdf = pd.DataFrame({"series_id": "A", "bar_date": pd.date_range("2000-01-01", periods=260).date, "y": Y, "x": X})
    return row_index(spark.createDataFrame(pdf))


def terms_of(trend, p, q, causal):
    return eco._ardl_terms((p, q), ["xa"], trend, causal)


def design(terms, lag, y=Y, x=X):
    of = {"y": y, "xa": x}
    at = np.arange(lag, len(y))
    column = lambda t: np.ones(len(at)) if t == "1" else at + 1.0 if t == "t" else of[t.rstrip("0123456789")][at - int(t[len(t.rstrip("0123456789")) :])]
    return np.column_stack([column(t) for t in terms]), y[lag:]


@pytest.mark.parametrize("trend", ["n", "c", "t", "ct"])
def test_trends_are_least_squares(series, trend):
    for causal in (True, False):
        fit = eco.ardl_fit(series, "y", ["x"], fixed_order=(2, 3), trend=trend, causal=causal, size=64).first()
        d, target = design(terms_of(trend, 2, 3, causal), 3)
        beta, ssr = np.linalg.lstsq(d, target, rcond=None)[:2]
        assert fit.terms == terms_of(trend, 2, 3, causal) and ("xa0" in fit.terms) != causal
        np.testing.assert_allclose(fit.coefs, beta, rtol=1e-6, atol=1e-8)
        sst = ((target - target.mean()) ** 2).sum() if "c" in trend else (target**2).sum()
        assert fit.r2 == pytest.approx(1 - ssr[0] / sst, abs=1e-9) and fit.n_rows == 260 and not fit.is_fallback
        n = len(target)
        assert fit.llf == pytest.approx(-n / 2 * (np.log(2 * np.pi) + np.log(ssr[0] / n) + 1), abs=1e-4)


def test_fixed_orders_are_causal_and_unknown_trends_refused(series):
    assert eco.ardl_fit(series, "y", ["x"], fixed_order=(1, 1)).first().terms == ["1", "y1", "xa1"]
    assert "xa0" in eco.ardl_fit(series, "y", ["x"], max_lags=1).first().terms
    with pytest.raises(ValueError):
        eco.ardl_fit(series, "y", trend="x")


@pytest.mark.parametrize("actual", [None, "y"])
def test_forecasts_with_given_futures(spark, series, actual):
    fit = eco.ardl_fit(series, "y", ["x"], fixed_order=(2, 2), trend="ct")
    b = dict(zip(fit.first().terms, fit.first().coefs))
    ahead_x, ahead_y = {1: 30.0, 2: 31.0, 4: 28.0}, {1: 90.0, 2: None, 4: 95.0}
    future = spark.createDataFrame([("A", k, ahead_x[k], ahead_y[k]) for k in ahead_x] + [("B", 1, 1.0, 1.0), ("A", 9, 1.0, 1.0)], "series_id string, step int, x double, y double")
    y, x, want = list(Y), list(X), []
    for k in range(1, 6):
        x.append(ahead_x.get(k, x[-1]))
        f = b["1"] + b["t"] * (260 + k) + b["y1"] * y[-1] + b["y2"] * y[-2] + b["xa1"] * x[-2] + b["xa2"] * x[-3]
        want.append(f)
        y.append(ahead_y[k] if actual and ahead_y.get(k) is not None else f)
    got = eco.ardl_forecast(fit, 5, 1, future=future, xs=["x"], actual=actual).orderBy("step").collect()
    assert [r.forecast for r in got] == pytest.approx(want)


def test_failed_fit_repeats_the_last_value(spark):
    flat = row_index(spark.createDataFrame(pd.DataFrame({"series_id": "K", "bar_date": pd.date_range("2000-01-01", periods=30).date, "y": 5.0})))
    got = eco.ardl_forecast(eco.ardl_fit(flat, "y", max_lags=2), 3).collect()
    assert [r.forecast for r in got] == [5.0] * 3


@pytest.mark.parametrize("horizon", [1, 3])
def test_rolling_regression_refits_every_window(series, horizon):
    window, p, q = 60, 2, 2
    holed = series.withColumns({"x": F.when(F.col("row_idx") != 120, F.col("x")), "w": F.sin(F.col("row_idx"))})
    out = rolling.rolling_fit_predict(holed, "y", window, p, horizon, "f", size=80, regressors=["x", "w"], x_lags=q).toPandas().sort_values("row_idx", ignore_index=True)
    w = np.sin(np.arange(260))
    x = X.copy()
    for t in range(260):
        if t < window - 1 or 120 in range(t - window + 1, t + 1):
            assert np.isnan(out.f[t]) and out.is_fallback[t] == (t >= window - 1)
            continue
        lo, at = t - window + 1, np.arange(t - window + 1 + 2, t + 1)
        d = np.column_stack([np.ones(len(at)), Y[at - 1], Y[at - 2], x[at - 1], x[at - 2], w[at - 1], w[at - 2]])
        b = np.linalg.lstsq(d, Y[at], rcond=None)[0]
        ys, xs, ws = list(Y[lo : t + 1]), [*x[lo : t + 1]], [*w[lo : t + 1]]
        for _ in range(horizon):
            step = b @ [1, ys[-1], ys[-2], xs[-1], xs[-2], ws[-1], ws[-2]]
            ys.append(step), xs.append(xs[-1]), ws.append(ws[-1])
        assert out.f[t] == pytest.approx(step, rel=1e-6)
    assert list(out.target_idx) == [t + horizon for t in range(260)]


def test_rolling_failure_is_null_or_the_last_value(spark):
    pdf = pd.DataFrame({"series_id": "K", "bar_date": pd.date_range("2020-01-01", periods=80).date, "close": 5.0, "x": 1.0})
    df = row_index(spark.createDataFrame(pdf))
    for regressors in ((), ("x",)):
        null = rolling.rolling_fit_predict(df, "close", 60, 1, regressors=regressors)
        last = rolling.rolling_fit_predict(df, "close", 60, 1, regressors=regressors, on_failure="last")
        assert null.filter("ar_forecast IS NOT NULL").count() == 0 and null.filter("is_fallback").count() == 21
        assert last.filter("ar_forecast = 5.0").count() == 21
    with pytest.raises(ValueError):
        rolling.rolling_fit_predict(df, "close", 8, 3, regressors=("x",), x_lags=3)


@pytest.mark.parametrize("case", [1, 2, 3, 4, 5])
def test_bounds_cases(series, case):
    got = eco.bounds_f_screen(series, "y", ["x"], case=case, fixed_order=(2, 1), bounds=(4.0, 5.0), size=64).first()
    at = np.arange(3, 260)  # the moments hold one lag more than the order
    dy, one, t = Y[at] - Y[at - 1], np.ones(len(at)), at + 1.0
    short = [Y[at - 1] - Y[at - 2], X[at] - X[at - 1]]
    fixed = {1: [], 2: [one], 3: [one], 4: [one, t], 5: [one, t]}[case]
    kept = {1: [], 2: [], 3: [one], 4: [one], 5: [one, t]}[case]
    ssr = lambda cols: float(((dy - np.column_stack(cols) @ np.linalg.lstsq(np.column_stack(cols), dy, rcond=None)[0]) ** 2).sum())
    free, tied = ssr([Y[at - 1], X[at - 1], *fixed, *short]), ssr([*kept, *short])
    k = 2 + len(fixed) - len(kept)
    want = ((tied - free) / k) / (free / (len(at) - 4 - len(fixed)))
    assert got.f_statistic == pytest.approx(want, rel=1e-5) and got.has_relation == (True if want > 5 else False if want < 4 else None)


def test_bounds_need_a_table_or_bounds(series):
    for case, bounds in ((1, None), (6, (1.0, 2.0))):
        with pytest.raises(ValueError):
            eco.bounds_f_screen(series, "y", ["x"], case=case, bounds=bounds)


def test_guard_flags_second_order_series(spark):
    rng = np.random.default_rng(3)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(size=400)
    pdf = pd.concat([pd.DataFrame({"series_id": k, "bar_date": pd.date_range("2000-01-01", periods=400).date, "y": y, "x": x}) for k, y, x in (("ok", walk, noise), ("bad", np.cumsum(walk), noise))])
    got = {r.series_id: r for r in eco.bounds_guarded(row_index(spark.createDataFrame(pdf)), "y", ["x"], max_lags=2).collect()}
    assert got["ok"].integration_orders == {"y": "I(1)", "x": "I(0)"} and got["ok"].is_valid
    assert got["bad"].integration_orders == {"y": "I(2)+", "x": "I(0)"} and not got["bad"].is_valid and got["bad"].f_statistic is not None
