"""Known answers and metamorphic properties of the statistics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import special
from barloom.operators import calibration as cal, drift, econometrics as eco, folds, metrics, stats
from barloom.plans.panel import row_index


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


# --- special functions against exact sums and published values
def test_tail_probabilities():
    exact = sum(math.comb(60, i) for i in range(36, 61)) / 2**60
    assert special.binomial_greater(36, 60)[()] == pytest.approx(exact, rel=1e-12)
    assert special.binomial_two_sided(744, 1574)[()] == pytest.approx(0.03212, abs=1e-5)
    assert special.binomial_greater(744, 1574)[()] == pytest.approx(0.98586, abs=1e-5)
    low, high = special.clopper_pearson(744, 1574)
    assert (low[0], high[0]) == (pytest.approx(0.44777, abs=1e-5), pytest.approx(0.49769, abs=1e-5))
    assert special.student_two_sided(2.228139, 10)[0] == pytest.approx(0.05, abs=1e-6)
    assert special.student_two_sided(3.9658, 1573)[0] == pytest.approx(7.64e-5, rel=2e-3)
    assert special.kolmogorov_tail(np.array([0.5324]), np.array([1574]))[0] < 1e-100


# --- drift
def _psi(spark, ref, cur):
    long = frame(spark, feature="f", value=np.concatenate([ref, cur]), is_reference=[True] * len(ref) + [False] * len(cur))
    return drift.with_status(drift.psi(long, ["feature"])).first()


def test_psi_bands(spark):
    rng = np.random.default_rng(0)
    ref = rng.normal(size=5000)
    assert _psi(spark, ref, rng.normal(size=5000)).psi < 0.05
    assert _psi(spark, ref, rng.normal(2, 1, 5000)).status == "alert"
    assert _psi(spark, ref, rng.normal(0, 3, 5000)).psi > 0.25
    far = _psi(spark, ref, rng.normal(20, 1, 5000))
    assert far.is_saturated and far.psi == pytest.approx(8.281024482111189, abs=1e-9)


def test_psi_degenerate_and_empty(spark):
    same = _psi(spark, np.ones(50), np.ones(50))
    assert same.psi == pytest.approx(0.0, abs=1e-12)
    empty = _psi(spark, np.arange(50.0), np.array([]))
    assert empty.psi is None and empty.status == "unknown"


def test_psi_report_flags_only_drifted(spark):
    rng = np.random.default_rng(1)
    n = 2000
    wide = frame(spark, stable=rng.normal(size=2 * n), drifted=np.concatenate([rng.normal(size=n), rng.normal(3, 1, n)]), is_reference=[True] * n + [False] * n)
    rows = drift.psi_report(drift.long_features(wide, ["is_reference"], ["stable", "drifted", "absent"]), ["feature"]).collect()
    assert [(r.feature, r.status) for r in rows] == [("drifted", "alert"), ("stable", "stable")]


# --- accuracy tests
def test_diebold_mariano_directions(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=500)
    df = frame(spark, k="a", actual=y, good=y + rng.normal(0, 0.3, 500), bad=y + rng.normal(0, 1.5, 500))
    r = stats.diebold_mariano(df, "good", "bad", ["k"]).first()
    assert r.dm_statistic < 0 and r.p_value < 0.01 and r.interpretation.startswith("model1")
    assert stats.diebold_mariano(df, "bad", "good", ["k"]).first().dm_statistic == pytest.approx(-r.dm_statistic)
    l1, l2 = (df.toPandas().actual - df.toPandas().good) ** 2, (df.toPandas().actual - df.toPandas().bad) ** 2
    d = (l1 - l2).to_numpy()
    assert r.dm_statistic == pytest.approx(d.mean() / np.sqrt(d.var() / 500) * np.sqrt(499 / 500), rel=1e-9)
    same = stats.diebold_mariano(df.withColumn("bad", F.col("good")), "good", "bad", ["k"]).first()
    assert same.dm_statistic == 0 and same.p_value == 1


def test_dm_horizon_three(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, k="a", row_idx=np.arange(200), actual=rng.normal(size=200), f=rng.normal(size=200), g=rng.normal(size=200) / 2)
    r = stats.dm_statistic(df, "f", "g", ["k"], h=3, loss="absolute").first()
    p = df.toPandas()
    d = (np.abs(p.actual - p.f) - np.abs(p.actual - p.g)).to_numpy()
    v = d.var() + sum(2 * (1 - k / 3) * np.cov(d[k:], d[:-k])[0, 1] for k in (1, 2))
    assert r.dm_statistic == pytest.approx(d.mean() / np.sqrt(v / 200) * np.sqrt((200 + 1 - 6 + 6 / 200) / 200), rel=1e-9)


# --- calibration
def _samples(spark, sigma):
    rng = np.random.default_rng(0)
    n, m = 300, 200
    y = rng.normal(size=n)
    s = rng.normal(0, sigma, (n, m))
    samples = frame(spark, row=np.repeat(np.arange(n), m), sample_id=np.tile(np.arange(m), n), value=s.ravel())
    return samples, frame(spark, row=np.arange(n), actual=y), s, y


def test_calibrated_and_overconfident(spark):
    samples, actuals, s, y = _samples(spark, 1.0)
    summ = cal.sample_summary(samples, actuals, ["row"]).withColumn("k", F.lit("m"))
    for r in cal.empirical_coverage(summ, ["k"]).collect():
        assert abs(r.gap) < 0.08
        lo, hi = np.quantile(s, [(1 - r.nominal) / 2, 1 - (1 - r.nominal) / 2], axis=1)
        assert r.empirical == pytest.approx(np.mean((y >= lo) & (y <= hi)))
    assert cal.ks_uniform(summ, ["k"]).first().ks_pvalue > 0.01
    tight = cal.sample_summary(_samples(spark, 0.2)[0], actuals, ["row"]).withColumn("k", F.lit("m"))
    assert all(r.gap < -0.2 for r in cal.empirical_coverage(tight, ["k"]).collect())


def test_coverage_example_and_edge_bins(spark):
    df = frame(spark, k="m", actual=[0.0, 1.0, 2.0, 3.0, 10.0], lo=-1.0, hi=1.0)
    assert df.agg(metrics.coverage_of("lo", "hi")).first()[0] == 0.4
    bins = frame(spark, pit=[0.0, 0.3, 0.6, 0.7, 1.0, 0.1]).select(cal.pit_bin("pit")).collect()
    assert [b[0] for b in bins] == [0, 2, 5, 6, 9, 1]


# --- folds
@pytest.mark.parametrize("n", [3774, 2000, 3000, 2500, 4174])
def test_fold_invariants(spark, n):
    rows = spark.range(n).select(F.lit("s").alias("series_id"), F.col("id").alias("row_idx"), F.lit(n).cast("long").alias("n_rows"))
    b = folds.fold_boundaries(rows).orderBy("fold").collect()
    assert [r.test_start for r in b] == [r.train_end for r in b]
    assert [r.test_start for r in b[1:]] == [r.test_end for r in b[:-1]] and b[-1].test_end == n and b[0].train_end == int(n * 0.55)
    if n == 4174:
        assert [b[0].train_end, *[r.test_end for r in b]] == [2295, 2670, 3045, 3420, 3795, 4174]
        scored = folds.test_rows(rows, 60).groupBy("fold").count().orderBy("fold").collect()
        assert [r["count"] for r in scored] == [314, 314, 314, 314, 318]
    ex = folds.expand_folds(rows)
    for k in (1, 3):
        parts = {r: ex.filter((F.col("fold") == k) & (F.col("role") == r)).select("row_idx") for r in ("train", "val", "test")}
        assert parts["train"].intersect(parts["test"]).isEmpty() and parts["val"].intersect(parts["test"]).isEmpty()
    tests = ex.filter("role = 'test'").groupBy("row_idx").count()
    assert tests.count() == n - b[0].train_end and tests.filter("count > 1").isEmpty()


# --- econometrics
@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(1)
    n = 400
    rw, noise = np.cumsum(rng.normal(size=n)), np.random.default_rng(3).normal(size=n)
    ar = np.zeros(n)
    for t in range(2, n):
        ar[t] = 0.6 * ar[t - 1] - 0.3 * ar[t - 2] + rng.normal()
    pdf = pd.concat([pd.DataFrame({"series_id": s, "row_idx": np.arange(n), "v": v}) for s, v in (("rw", rw), ("noise", noise), ("ar2", ar))])
    short = pd.DataFrame({"series_id": "short", "row_idx": np.arange(10), "v": rng.normal(size=10)})
    return spark.createDataFrame(pd.concat([pdf, short]))


def _adf_plain(y, lag):
    dy = np.diff(y)
    t = np.arange(lag, len(dy))
    x = np.column_stack([y[t]] + [dy[t - i] for i in range(1, lag + 1)] + [np.ones(len(t))])
    b, *_ = np.linalg.lstsq(x, dy[t], rcond=None)
    e = dy[t] - x @ b
    return b[0] / np.sqrt(e @ e / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0]), len(t)


def test_adf(walks):
    out = {r.series_id: r for r in eco.adf_screen(walks, "v", size=60).collect()}
    data = walks.toPandas()
    for s in ("rw", "noise", "ar2"):
        y = data[data.series_id == s].sort_values("row_idx").v.to_numpy()
        stat, n = _adf_plain(y, out[s].used_lag)
        assert out[s].adf_statistic == pytest.approx(stat, rel=1e-7) and out[s].nobs == n
    assert not out["rw"].is_stationary and out["noise"].is_stationary and out["ar2"].is_stationary
    assert out["short"].p_value == 1.0 and not out["short"].is_stationary
    assert eco.tau_p_value(-2.86154) == pytest.approx(0.05, abs=0.002)


def test_kpss_auto_bandwidth(walks):
    out = {r.series_id: r for r in eco.kpss_screen(walks, "v", size=60).collect()}
    data = walks.toPandas()
    for s in ("rw", "noise"):
        y = data[data.series_id == s].sort_values("row_idx").v.to_numpy()
        n, e = len(y), y - y.mean()
        m = int(n ** (2 / 9))
        prods = [2 * (e[i:] @ e[: n - i]) / n for i in range(1, m + 1)]
        hat = sum(i * p for i, p in enumerate(prods, 1)) / (e @ e / n + sum(prods))
        lags = int(1.1447 * (hat * hat) ** (1 / 3) * n ** (1 / 3))
        s2 = (e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[: n - i]) for i in range(1, lags + 1))) / n
        assert out[s].lags == lags and out[s].kpss_statistic == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / s2, rel=1e-9)
    assert not out["rw"].is_stationary and out["noise"].is_stationary and out["short"].p_value == 0.0


def test_differencing_and_integration(walks):
    d = {r.series_id: r for r in eco.auto_difference(walks.filter("series_id <> 'short'"), "v").collect()}
    assert d["noise"].diff_order == 0 and d["rw"].diff_order == 1 and d["rw"].passed
    i = {r.series_id: r.integration for r in eco.integration_order(walks.filter("series_id <> 'short'"), "v").collect()}
    assert i["noise"] == "I(0)" and i["rw"] == "I(1)"


def test_ar_and_arma_orders(walks):
    two = walks.filter("series_id = 'ar2'")
    assert eco.ar_order_select(two, "v").first().lags == 2
    r = eco.arma_order_select(two, "v").first()
    assert (r.p, r.q) == (2, 0) and r.phi[0] == pytest.approx(0.6, abs=0.15) and r.phi[1] == pytest.approx(-0.3, abs=0.15)


def test_moving_average_order_and_forecast(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=3000)
    y = 0.5 + e[1:] + 0.6 * e[:-1]
    df = frame(spark, series_id="m", row_idx=np.arange(len(y)), ret_1d=y)
    r = eco.arma_order_select(df.withColumn("segment", F.lit(1)), "ret_1d", segment="segment", n_segments=1)
    row = r.first()
    assert row.p == 0 and row.q >= 1 and row.theta[0] == pytest.approx(0.6, abs=0.08)
    f = eco.rolling_arma_forecast(df.withColumn("fold", F.lit(1)), r).toPandas().sort_values("row_idx")
    resid = y[1:] - f.arma_forecast.to_numpy()[:-1]
    assert resid[50:].var() < 1.1 < y.var()


@pytest.mark.parametrize("theta", [[0.6], [0.999], [-1.3, 0.8], [0.2, -0.5, 0.9]])
def test_innovations_are_exact_over_chunks(spark, theta):
    rng = np.random.default_rng(8)
    n, phi, const = 700, [0.4, -0.2], 0.1
    y = rng.normal(size=n)
    theta = eco._invertible(np.array(theta)).tolist()
    assert np.abs(np.roots([1.0, *theta])).max() <= 1.0 + 1e-9
    e, want = [], []
    for t in range(n):
        u = y[t] - const - sum(f * y[t - i] for i, f in enumerate(phi, 1)) if t >= 2 else 0.0
        e.append(u - sum(w * e[t - j] for j, w in enumerate(theta, 1) if t >= j))
        want.append(const + sum(f * y[t - i] for i, f in enumerate(phi) if t >= i) + sum(w * e[t - j] for j, w in enumerate(theta) if t >= j))
    df = frame(spark, series_id="m", row_idx=np.arange(n), ret_1d=y).withColumn("fold", F.when(F.col("row_idx") >= 300, F.lit(2)))
    params = spark.createDataFrame([("m", 2, const, phi, theta), ("m", 1, 0.0, [], [0.5])], "series_id string, segment int, const double, phi array<double>, theta array<double>")
    for size in (64, 65_536):
        got = eco.rolling_arma_forecast(df, params, size=size).toPandas().sort_values("row_idx")
        np.testing.assert_allclose(got.arma_forecast, want[300:], rtol=1e-9, atol=1e-9)


def test_ardl_recovers_coefficients(spark):
    rng = np.random.default_rng(7)
    n = 600
    x = np.cumsum(rng.normal(size=n))
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 2.0 + 0.5 * y[t - 1] + 0.8 * x[t] - 0.3 * x[t - 1] + 0.1 * rng.normal()
    df = frame(spark, series_id="s", row_idx=np.arange(n), y=y, x=x)
    fit = eco.ardl_fit(df, "y", ["x"], max_lags=4, size=100)
    r = fit.first()
    got = dict(zip(r.terms, r.coefs))
    assert r.order == [1, 1] and not r.is_fallback and r.r2 > 0.99
    for term, want in {"1": 2.0, "y1": 0.5, "xa0": 0.8, "xa1": -0.3}.items():
        assert got[term] == pytest.approx(want, abs=0.1)
    path = [q.forecast for q in eco.ardl_forecast(fit, 2, 1).orderBy("step").collect()]
    first = got["1"] + got["y1"] * y[-1] + got["xa0"] * x[-1] + got["xa1"] * x[-1]
    assert path[0] == pytest.approx(first, rel=1e-9) and path[1] == pytest.approx(got["1"] + got["y1"] * first + (got["xa0"] + got["xa1"]) * x[-1], rel=1e-9)


def test_bounds_and_cointegration(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = np.cumsum(rng.normal(size=n)) + 100
    tied, free = 2 * x + rng.normal(size=n), np.cumsum(rng.normal(size=n)) + 50
    df = pd.concat([pd.DataFrame({"series_id": s, "row_idx": np.arange(n), "y": y, "x": x}) for s, y in (("tied", tied), ("free", free))])
    b = {r.series_id: r for r in eco.bounds_f_screen(spark.createDataFrame(df), "y", ["x"]).collect()}
    assert b["tied"].has_relation and b["tied"].ec_speed < 0 and b["tied"].long_run[0] == pytest.approx(2.0, abs=0.05)
    assert b["free"].f_statistic < b["tied"].f_statistic and b["free"].has_relation is not True
    days = pd.date_range("2020-01-01", periods=n).date
    pairs = pd.concat([pd.DataFrame({"a": a, "b": "x", "bar_date": days, "y": y, "x": x}) for a, y in (("tied", tied), ("free", free))])
    c = {r.a: r for r in eco.cointegration_screen(spark.createDataFrame(pairs)).collect()}
    assert c["tied"].is_cointegrated and not c["free"].is_cointegrated


def test_singular_ardl_falls_back(spark):
    t = np.arange(100.0)
    df = frame(spark, series_id="s", row_idx=np.arange(100), y=np.sin(t), x=np.zeros(100))
    r = eco.ardl_fit(df, "y", ["x"], max_lags=2, fixed_order=None).first()
    assert r.is_fallback


# --- causality of every feature
def test_features_use_no_later_rows(bars):
    from barloom.operators.features import FEATURES, engineer_features

    full = engineer_features(bars)
    cols = [c for c in FEATURES if c in full.columns and c != "RSI"]
    late = engineer_features(bars.filter("bar_date <= DATE '2019-06-01'"))
    key = ["series_id", "bar_date", *[F.round(c, 7).alias(c) for c in cols]]
    assert late.select(*key).exceptAll(full.filter("bar_date <= DATE '2019-06-01'").select(*key)).isEmpty()
    seeded = "row_idx >= 15"  # the first rows of RSI share a seed of 15 moves
    a = late.filter(seeded).select("series_id", "bar_date", F.round("RSI", 7).alias("r"))
    assert a.exceptAll(full.filter(seeded).select("series_id", "bar_date", F.round("RSI", 7).alias("r"))).isEmpty()


def test_macro_feature_count(spark, bars):
    from barloom.operators.features import FEATURES, engineer_features

    names = ("VIX", "TNX", "IRX", "DXY", "GLD", "TLT")
    days = bars.select(F.col("bar_date").alias("obs_date")).distinct().filter("dayofmonth(obs_date) % 3 = 0")
    macro = days.select("obs_date", *[(F.abs(F.hash("obs_date", F.lit(n))) % 100 + 1.0).alias(n) for n in names])
    out = engineer_features(bars, macro, warmup="bfill")
    assert len(FEATURES) == 39 and set(FEATURES) <= set(out.columns)
    assert out.filter(" OR ".join(f"{c} IS NULL" for c in FEATURES)).isEmpty()


def test_population_scaler(spark):
    df = frame(spark, fold=1, a=[1.0, 2.0, 3.0], b=[5.0, 5.0, 5.0])
    s = {r.feature: (r["mean"], r.scale) for r in folds.fit_scaler(df, ["a", "b"], ["fold"]).collect()}
    assert s["a"] == (2.0, pytest.approx(np.std([1, 2, 3]))) and s["b"] == (5.0, 1.0)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(9)
    p, y = rng.normal(0, 0.01, 300), rng.normal(0, 0.01, 300)
    df = frame(spark, k="a", row_idx=np.arange(300), pred=p, actual=y)
    m = metrics.forecast_metrics(df, ["k"]).first()
    assert m.ic == pytest.approx(np.corrcoef(p, y)[0, 1]) and m.rmse == pytest.approx(np.sqrt(np.mean((p - y) ** 2)))
    b = metrics.backtest(df, ["k"]).first()
    sig = np.sign(p)
    r = sig * y - (np.diff(sig, prepend=0) != 0) * 0.001
    ex = r - 0.02 / 252
    eq = np.cumprod(1 + r)
    assert b.sharpe == pytest.approx(np.sqrt(252) * ex.mean() / r.std()) and b.sortino == pytest.approx(np.sqrt(252) * ex.mean() / ex[ex < 0].std())
    assert b.max_drawdown == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min()) and b.annual_return == pytest.approx(eq[-1] ** (252 / 300) - 1)
    flat = metrics.forecast_metrics(df.withColumn("pred", F.lit(0.0)), ["k"]).first()
    assert flat.ic == 0 and flat.sharpe_naive == 0


def test_row_index_needs_no_sorted_input(spark):
    df = spark.range(5000).select(F.lit("s").alias("series_id"), F.date_add(F.lit("1990-01-01").cast("date"), ((F.col("id") * 37) % 5000).cast("int")).alias("bar_date"))
    out = row_index(df, length="n")
    assert out.filter("row_idx <> datediff(bar_date, DATE '1990-01-01') OR n <> 5000").isEmpty()
