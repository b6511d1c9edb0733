"""Conditional sums of squares: chunked sums equal whole-series recursions, steps never raise the sum."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import arma_css, econometrics as eco
from barloom.plans.panel import row_index


def simulated(n, phi, theta, const=0.1, seed=0):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(3, n + 200):
        y[t] = const + sum(f * y[t - i] for i, f in enumerate(phi, 1)) + e[t] + sum(w * e[t - j] for j, w in enumerate(theta, 1))
    return y[200:]


def residuals(y, const, phi, theta):
    e = np.zeros(len(y))
    for t in range(len(phi), len(y)):
        e[t] = y[t] - const - sum(f * y[t - i] for i, f in enumerate(phi, 1)) - sum(w * e[t - j] for j, w in enumerate(theta, 1) if t >= j)
    return e


def panel_of(spark, series):
    return row_index(spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": k, "bar_date": pd.date_range("2000-01-01", periods=len(y)).date, "r": y}) for k, y in series.items()])))


def start_of(spark, rows):
    return spark.createDataFrame(rows, "series_id string, const double, phi array<double>, theta array<double>")


def test_basis_columns_are_the_derivatives():
    y = simulated(90, (0.5, -0.2), (0.4, 0.3))
    at = np.array([0.05, 0.4, -0.1, 0.3, 0.2])
    whole = lambda a: residuals(y, a[0], a[1:3], a[3:])
    want = np.column_stack([whole(at)] + [(whole(at + h) - whole(at - h)) / 2e-6 for h in 1e-6 * np.eye(5)])
    state, got = np.zeros(12), []
    for lo in range(0, 90, 30):  # three chunks, each with two rows of halo
        begin = max(0, lo - 2)
        b = arma_css.basis(y[begin : lo + 30], 30, begin, at[0], at[1:3], at[3:])
        pick = arma_css._selector(state, 2, 2)
        got.append(b @ pick)
        state = (b[::-1][:2] @ pick).T.ravel()
    np.testing.assert_allclose(np.vstack(got), want, atol=1e-7)


@pytest.mark.parametrize("size", [50, 100_000])
def test_sum_is_whole_and_never_rises(spark, size):
    series = {"A": simulated(600, (0.6, -0.3), (0.5,)), "B": simulated(300, (), (0.7, 0.2), seed=1), "C": simulated(260, (0.4,), (), seed=2)}
    begin = {"A": (0.0, [0.1, 0.0], [0.0]), "B": (0.0, [], [0.1, 0.0]), "C": (1.0, [-0.5], [])}
    df, start = panel_of(spark, series), start_of(spark, [(k, *v) for k, v in begin.items()])
    last = None
    for rounds in (1, 3, 25):
        got = {r.series_id: r for r in arma_css.css_fit(df, "r", start, rounds=rounds, size=size).collect()}
        for k, r in got.items():
            assert r.ss == pytest.approx((residuals(series[k], r.const, r.phi, r.theta) ** 2).sum(), rel=1e-10)
            assert r.ss_start == pytest.approx((residuals(series[k], *begin[k]) ** 2).sum(), rel=1e-10)
            assert last is None or r.ss <= last[k] * (1 + 1e-12)
        last = {k: r.ss for k, r in got.items()}
    assert all(r.is_settled and r.gradient < 1e-3 for r in got.values())
    assert got["A"].phi == pytest.approx([0.6, -0.3], abs=0.12) and got["A"].theta == pytest.approx([0.5], abs=0.12)
    assert got["C"].sigma2 == pytest.approx(got["C"].ss / 259)


def test_nested_segments(spark):
    y = simulated(500, (0.5,), (0.4,), seed=3)
    df = panel_of(spark, {"A": y}).withColumn("seg", F.when(F.col("row_idx") < 200, 1).when(F.col("row_idx") < 350, 2).cast("int"))
    start = start_of(spark, [("A", 0.0, [0.2], [0.1])]).withColumn("seg", F.explode(F.array(F.lit(1), F.lit(2))))
    got = {r.seg: r for r in arma_css.css_fit(df, "r", start, segment="seg", size=64).collect()}
    for s, n in ((1, 200), (2, 350)):
        alone = arma_css.css_fit(panel_of(spark, {"A": y[:n]}), "r", start.filter(F.col("seg") == 1).drop("seg")).first()
        assert got[s].nobs == n and got[s].ss == pytest.approx(alone.ss, rel=1e-8) and got[s].phi == pytest.approx(alone.phi, abs=1e-4)


def test_short_and_missing(spark):
    y = simulated(80, (0.5,), (), seed=4)
    y[[3, 40]] = np.nan
    df = panel_of(spark, {"A": y, "S": np.array([0.1, 0.2, 0.3]), "N": np.full(5, np.nan)}).withColumn("r", F.nanvl("r", F.lit(None)))
    start = start_of(spark, [("A", 0.0, [0.0], []), ("S", 0.0, [0.0], [0.0])])
    got = {r.series_id: r for r in arma_css.css_fit(df, "r", start).collect()}
    kept = y[~np.isnan(y)]
    assert got["A"].nobs == 78 and got["A"].ss == pytest.approx((residuals(kept, got["A"].const, got["A"].phi, []) ** 2).sum())
    assert got["S"].ss is None and got["S"].const == 0.0 and not got["S"].is_settled


def test_refined_orders_of_a_simulated_process(spark):
    y = simulated(4000, (0.7, -0.4), (0.6,), seed=5)
    df = panel_of(spark, {"A": y})
    chosen = eco.arma_order_select(df, "r").first()
    assert (chosen.p, chosen.q) == (2, 1)
    fit = arma_css.css_fit(df, "r", eco.arma_order_select(df, "r"), size=1000).first()
    assert fit.ss <= fit.ss_start and fit.phi == pytest.approx([0.7, -0.4], abs=0.06) and fit.theta == pytest.approx([0.6], abs=0.06)
