"""Chunked execution equals whole-series computation, with chunks far shorter than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import features as ft, metrics, recursive, regime, rolling
from barloom.operators.joins import asof_align
from barloom.plans import moments
from barloom.plans.panel import chunk_size, row_index, running, windowed
from barloom.plans.quantiles import exact_quantiles, ranked_values


@pytest.fixture(scope="module")
def panel(bars):
    return row_index(bars, length="n_rows")


def by_series(pdf, fn):
    return pd.concat([fn(g.sort_values("bar_date").reset_index(drop=True)) for _, g in pdf.groupby("series_id")], ignore_index=True)


def ordered(df):
    return df.toPandas().sort_values(["series_id", "row_idx"], ignore_index=True)


def test_row_index(panel, bars_pdf):
    got = ordered(panel)
    want = by_series(bars_pdf, lambda g: g.assign(row_idx=range(len(g)), n_rows=len(g)))
    assert list(got.row_idx) == list(want.row_idx) and list(got.n_rows) == list(want.n_rows) and list(got.bar_date) == list(want.bar_date)


def test_windowed_across_chunks(panel, bars_pdf):
    got = ordered(windowed(panel, lambda d, w: d.withColumns({"m": ft.sma("close", w, 20), "t": ft.returns_target(w, 5, False)}), back=19, ahead=5, size=32))
    want = by_series(bars_pdf, lambda g: g.assign(m=g.close.rolling(20, min_periods=1).mean(), t=g.close.shift(-5) / g.close - 1))
    np.testing.assert_allclose(got.m, want.m, rtol=1e-12)
    np.testing.assert_allclose(got.t.astype(float), want.t, rtol=1e-10)


@pytest.mark.parametrize("full", [True, False])
def test_moving_means(panel, bars_pdf, full):
    got = ordered(windowed(panel, lambda d, w: ft.moving_means(d, w, {"m": ("close", 50)}, full), back=49, size=64))
    want = by_series(bars_pdf, lambda g: g.assign(m=g.close.rolling(50, min_periods=50 if full else 1).mean()))
    np.testing.assert_allclose(got.m.astype(float), want.m, rtol=1e-12)


def test_running_kinds(panel, bars_pdf):
    some = F.when(F.col("row_idx") % 40 == 7, F.col("close"))
    specs = {"s": ("sum", "volume"), "p": ("product", 1 + (F.col("close") - 100) / 1e5), "x": ("max", "close"), "n": ("min", "close"), "l": ("last", some), "f": ("next", some)}
    got = ordered(running(panel, specs, size=25))

    def brute(g):
        v = g.close.where(g.index % 40 == 7)
        return g.assign(s=g.volume.cumsum(), p=(1 + (g.close - 100) / 1e5).cumprod(), x=g.close.cummax(), n=g.close.cummin(), l=v.ffill(), f=v.bfill())

    want = by_series(bars_pdf, brute)
    for c in specs:
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-11, err_msg=c)


def _rsi_loop(x, n=14):
    """Wilder's average written out step by step, seeded from the first n + 1 moves."""
    d = np.diff(x)
    seed = d[: n + 1]
    up, down = seed[seed >= 0].sum() / n, -seed[seed < 0].sum() / n
    out = np.zeros(len(x))
    out[:n] = 100 - 100 / (1 + (up / down if down else 0))
    for i in range(n, len(x)):
        up, down = (up * (n - 1) + max(d[i - 1], 0)) / n, (down * (n - 1) + max(-d[i - 1], 0)) / n
        out[i] = 100 - 100 / (1 + (up / down if down else 0))
    return out


def _bars_of(spark, close, high=None, low=None):
    n = len(close)
    close = np.asarray(close, dtype=float)
    pdf = pd.DataFrame({"series_id": "S", "bar_date": pd.date_range("2000-01-01", periods=n).date, "open": close, "high": close + 1 if high is None else high, "low": close - 1 if low is None else low, "close": close, "volume": np.arange(n) % 7 + 1.0})
    return row_index(spark.createDataFrame(pdf)), pdf


def _indicators(pdf):
    """All indicators of one whole series, by the plain recurrences."""
    ewm = lambda x, s: pd.Series(x).ewm(span=s, adjust=False).mean().to_numpy()
    high, low, close = (pdf[c].to_numpy() for c in ("high", "low", "close"))
    prev = np.concatenate([close[:1], close[:-1]])
    macd = ewm(close, 12) - ewm(close, 26)
    up, down = np.diff(high, prepend=high[0]), -np.diff(low, prepend=low[0])
    plus, minus = ewm(np.where((up > down) & (up > 0), up, 0.0), 14), ewm(np.where((down > up) & (down > 0), down, 0.0), 14)
    flow = np.sign(close - prev) * pdf["volume"].to_numpy()
    flow[0] = pdf["volume"].iloc[0]
    return {
        "RSI": _rsi_loop(close), "MACD": macd, "MACD_Signal": ewm(macd, 9), "MACD_Hist": macd - ewm(macd, 9), "OBV": np.cumsum(flow),
        "ATR": ewm(np.maximum(high - low, np.maximum(abs(high - prev), abs(low - prev))), 14), "ADX": ewm(100 * abs(plus - minus) / (plus + minus + 1e-10), 14),
    }


def test_indicators_with_flat_and_rising_stretches(spark):
    x = np.concatenate([100 + np.cumsum(np.random.default_rng(1).normal(size=300)), np.full(900, 90.0), 90 + np.arange(600.0)])
    df, pdf = _bars_of(spark, x)
    got = ordered(recursive.add_indicators(df, size=300))
    for c, want in _indicators(pdf).items():
        np.testing.assert_allclose(got[c], want, rtol=1e-9, atol=1e-9, err_msg=c)


def test_nothing_before_a_chunk_is_forgotten(spark):
    """Values 1e15 times larger, long before a chunk's halo, still count."""
    rng = np.random.default_rng(4)
    x = 100 + np.cumsum(rng.normal(size=1500))
    x[40:60] *= 1e15
    high, low = x + rng.random(1500), x - rng.random(1500)
    df, pdf = _bars_of(spark, x, high, low)
    got, want = ordered(recursive.add_indicators(df, size=300)), _indicators(pdf)
    for c in ("MACD", "MACD_Signal", "ATR", "ADX"):
        late = np.arange(1500) >= 300  # chunks that don't hold the spike
        np.testing.assert_allclose(got[c][late], want[c][late], rtol=1e-12, atol=1e-12 * np.abs(want[c][late]).max(), err_msg=c)
    e = ordered(recursive.ema(df, "close", 26, "e", size=64))
    np.testing.assert_allclose(e.e, pd.Series(x).ewm(span=26, adjust=False).mean(), rtol=1e-12)


def test_indicators_across_chunks(panel, bars_pdf):
    got = ordered(recursive.add_indicators(panel, size=290))
    for s in "ABC":
        mine = got[got.series_id == s].reset_index(drop=True)
        for c, want in _indicators(bars_pdf[bars_pdf.series_id == s].sort_values("bar_date")).items():
            np.testing.assert_allclose(mine[c], want, rtol=1e-9, atol=1e-9, err_msg=c)
    with pytest.raises(ValueError):
        recursive.add_indicators(panel, size=260)


def test_missing_prices_repeat_the_bar_before(spark):
    x = 100 + np.cumsum(np.random.default_rng(9).normal(size=900))
    df, pdf = _bars_of(spark, x)
    gap = F.col("row_idx").isin(5, 6, 299, 300, 301, 600)
    holes = df.withColumns({c: F.when(~gap, F.col(c)) for c in ("high", "low", "close")})
    for c in ("high", "low", "close"):
        pdf.loc[[5, 6, 299, 300, 301, 600], c] = np.nan
        pdf[c] = pdf[c].ffill()
    got = ordered(recursive.add_indicators(holes, size=300))
    for c, want in _indicators(pdf).items():
        if c != "OBV":
            np.testing.assert_allclose(got[c].astype(float), want, rtol=1e-9, atol=1e-9, err_msg=c)


def test_ema_with_short_chunks(spark, panel, bars_pdf):
    got = ordered(recursive.ema(panel, "close", 3, "e", size=7))
    want = by_series(bars_pdf, lambda g: g.assign(e=g.close.ewm(span=3, adjust=False).mean()))
    np.testing.assert_allclose(got.e, want.e, rtol=1e-12)
    x = np.where(np.arange(40) % 9 < 4, np.nan, np.arange(40.0))  # missing at the start, inside and over whole chunks
    df, _ = _bars_of(spark, np.zeros(40))
    holes = df.withColumn("v", F.when(F.col("row_idx") % 9 >= 4, F.col("row_idx").cast("double")))
    np.testing.assert_allclose(ordered(recursive.ema(holes, "v", 5, "e", size=3)).e.astype(float), pd.Series(x).ewm(span=5, adjust=False, ignore_na=True).mean(), rtol=1e-12)


def test_features_plan_has_few_exchanges(bars):
    macro = bars.sparkSession.sql("SELECT DATE'2018-01-01' AS obs_date, 1.0D AS VIX, 2.0D AS TNX")
    plan = ft.engineer_features(bars, macro)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6


def test_rolling_ar_matches_least_squares(panel, bars_pdf):
    got = ordered(rolling.rolling_ar(panel, 60, 3, size=100))
    a = got[got.series_id == "A"].reset_index(drop=True)
    y = a.close.to_numpy()
    for t in (59, 60, 99, 100, 101, 555, 899):
        w = y[t - 59 : t + 1]
        x = np.column_stack([np.ones(57)] + [w[3 - k : 60 - k] for k in (1, 2, 3)])
        b = np.linalg.lstsq(x, w[3:], rcond=None)[0]
        assert abs(a.ar_forecast[t] - (b[0] + b[1:] @ w[-1:-4:-1])) < 1e-7
    assert a.ar_forecast[:59].isna().all() and not a.is_fallback.any()


def test_rolling_ar_constant_series_falls_back(spark):
    pdf = pd.DataFrame({"series_id": "K", "bar_date": pd.date_range("2020-01-01", periods=150).date, "close": 5.0})
    out = rolling.rolling_ar(row_index(spark.createDataFrame(pdf), length="n"))
    row = rolling.fallback_share(out).first()
    assert row.attempted == 31 and row.fallbacks == 31 and not row.within_cap
    with pytest.raises(RuntimeError):
        rolling.require_within_cap(out)


def test_horizon_two_is_labelled_two_rows_ahead(panel):
    out = ordered(rolling.rolling_fit_predict(panel, "close", 60, 1, 2))
    assert ((out.target_idx - out.row_idx) == 2).all()


def test_lag_moments_and_segments(panel, bars_pdf):
    z = panel.withColumn("seg", F.when(F.col("row_idx") < 50, 1).when(F.col("row_idx") < 100, 2).cast("int"))
    rows = moments.lag_moments(z, ["close"], 3, segment="seg", n_segments=3, size=40).collect()
    y = bars_pdf[bars_pdf.series_id == "B"].sort_values("bar_date").close.to_numpy()
    for r in rows:
        if r.series_id == "B":
            hi = {1: 50, 2: 100, 3: 100}[r.segment]
            v = np.column_stack([np.ones(hi - 3)] + [y[3 - k : hi - k] for k in range(4)])
            np.testing.assert_allclose(np.reshape(r.moments, (5, 5)), v.T @ v, rtol=1e-12)
    assert len(rows) == 9


def test_quantiles_with_forced_brackets(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=4000), np.zeros(3000), rng.exponential(size=1000)])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": x})).repartition(4)
    probs = [0, 0.1, 0.25, 0.5, 0.51, 0.9, 0.999, 1]
    got = exact_quantiles(df, ["k"], "v", probs, accuracy=500).first().quantiles
    np.testing.assert_allclose(got, np.quantile(x, probs), rtol=0, atol=1e-15)
    ranks = ranked_values(df, ["k"], "v", splits=7).toPandas().sort_values("value")
    assert ranks.n.sum() == len(x) and (ranks.first_rank.to_numpy()[1:] == ranks.last_rank.to_numpy()[:-1] + 1).all()


def test_drawdown_across_chunks(panel, bars_pdf):
    r = windowed(panel, lambda d, w: d.withColumn("r", F.coalesce(ft.pct_change("close", w), F.lit(0.0))), back=1)
    got = ordered(metrics.drawdown_path(r, ["r"], ["series_id"], size=37))
    want = by_series(bars_pdf, lambda g: g.assign(e=(1 + g.close.pct_change().fillna(0)).cumprod()))
    want["d"] = want.e / want.groupby("series_id").e.cummax() - 1
    np.testing.assert_allclose(got.drawdown_r, want.d, atol=1e-12)


def test_asof_keeps_null_of_latest_row(spark):
    left = spark.createDataFrame([("a", "2020-01-05"), ("a", "2020-01-01"), ("b", "2020-01-09")], "series_id string, d string").selectExpr("series_id", "date(d) bar_date", "1 one")
    right = spark.createDataFrame([("a", "2020-01-02", 1.0), ("a", "2020-01-04", None)], "series_id string, d string, v double").selectExpr("series_id", "date(d) obs_date", "v")
    got = {(r.series_id, str(r.bar_date)): r.v for r in asof_align(left, right, ["v"]).collect()}
    assert got == {("a", "2020-01-05"): None, ("a", "2020-01-01"): None, ("b", "2020-01-09"): None}


# --- regime
P = regime.Params([0.5, 0.5], [0.95, 0.05, 0.1, 0.9], [0.0, 0.0], [0.25, 9.0])


@pytest.fixture(scope="module")
def two_regimes(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.5, 200), rng.normal(0, 3.0, 200)])
    return x, spark.createDataFrame(pd.DataFrame({"series_id": "S", "row_idx": np.arange(400), "x": x}))


def params_df(spark, p=P):
    return spark.createDataFrame([("S", *[[float(v) for v in a] for a in p.flat()])], "series_id string, start array<double>, trans array<double>, means array<double>, vars array<double>")


def plain_forward(x, p):
    b = np.exp(regime.log_emission(x[:, None], p))
    out, a = [], p.start * b[0]
    for t in range(len(x)):
        a = a / a.sum() if t == 0 else (a @ p.trans) * b[t]
        a = a / a.sum()
        out.append(a)
    return np.array(out)


def test_filter_and_smoother_across_chunks(spark, two_regimes):
    x, df = two_regimes
    want = plain_forward(x, P)
    got = regime.hmm_filter(df, params_df(spark), ["x"], size=33).toPandas().sort_values("row_idx")
    np.testing.assert_allclose(np.stack(got.filtered), want, atol=1e-9)
    beta = np.ones((len(x), 2))
    b = np.exp(regime.log_emission(x[:, None], P))
    for t in range(len(x) - 2, -1, -1):
        beta[t] = P.trans @ (b[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    smooth = want * beta
    smooth /= smooth.sum(axis=1, keepdims=True)
    s = regime.hmm_smooth(df, params_df(spark), ["x"], size=33).toPandas().sort_values("row_idx")
    np.testing.assert_allclose(np.stack(s.noncausal_smoothed), smooth, atol=1e-9)


def test_best_path_across_chunks(spark, two_regimes):
    x, df = two_regimes
    logb, loga = regime.log_emission(x[:, None], P), np.log(P.trans)
    score, back = np.log(P.start) + logb[0], []
    for t in range(1, len(x)):
        s = score[:, None] + loga
        back.append(s.argmax(axis=0))
        score = s.max(axis=0) + logb[t]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    got = regime.hmm_viterbi(df, params_df(spark), ["x"], size=33).toPandas().sort_values("row_idx")
    assert list(got.noncausal_state) == path[::-1]


def test_filter_is_causal(spark, two_regimes):
    x, df = two_regimes
    full = regime.hmm_filter(df, params_df(spark), ["x"], size=50).toPandas().sort_values("row_idx")
    cut = regime.hmm_filter(df.filter("row_idx < 230"), params_df(spark), ["x"], size=50).toPandas().sort_values("row_idx")
    bent = df.withColumn("x", F.when(F.col("row_idx") >= 230, F.col("x") * 50).otherwise(F.col("x")))
    bent = regime.hmm_filter(bent, params_df(spark), ["x"], size=50).toPandas().sort_values("row_idx")
    for other in (cut, bent):
        np.testing.assert_allclose(np.stack(full.filtered[:230]), np.stack(other.filtered[:230]), atol=1e-10)
    np.testing.assert_allclose(np.stack(full.filtered).sum(axis=1), 1.0)


def test_fit_separates_regimes_and_distributed_fit_agrees(spark, two_regimes):
    _, df = two_regimes
    whole = regime.high_vol_state(regime.hmm_fit(df, ["x"])).first()
    split = regime._fit_distributed(df, ["x"], ["series_id"], 2, 200, 1e-3, 64).first()
    assert whole.vars[whole.high_vol_state] > 4 > whole.vars[1 - whole.high_vol_state]
    np.testing.assert_allclose(whole.vars, split.vars, rtol=1e-6)
    np.testing.assert_allclose(whole.trans, split.trans, rtol=1e-6)
    assert whole.iterations == split.iterations
    p = regime.high_vol_probability(df, regime.hmm_fit(df, ["x"]), ["x"]).toPandas().sort_values("row_idx").regime_high_vol_prob.to_numpy()
    assert p[:190].mean() < 0.2 < 0.8 < p[210:].mean()


@pytest.mark.parametrize("spoil", ["nulls", "constant"])
def test_both_fits_agree_on_nulls_and_constants(spark, two_regimes, spoil):
    _, df = two_regimes
    x = F.when(F.col("row_idx") % 3 == 0, None).otherwise(F.col("x")) if spoil == "nulls" else F.lit(2.5)
    df = df.withColumn("x", x.cast("double"))
    whole, split = regime.hmm_fit(df, ["x"], iters=4).first(), regime._fit_distributed(df, ["x"], ["series_id"], 2, 4, 1e-3, 64).first()
    for c in ("start", "trans", "means", "vars"):
        np.testing.assert_allclose(whole[c], split[c], rtol=1e-6, atol=1e-12)
    np.testing.assert_allclose(whole.log_likelihood, split.log_likelihood, rtol=1e-9)


def test_gates_of_a_fold_learn_from_its_own_validation_rows(spark):
    from barloom.operators import blend

    rng = np.random.default_rng(0)
    rows = [(f, r, float(v), 1.0 if (v > 0) == (f == 1) else -1.0, 0.0, 1.0) for f in (1, 2) for r in ("val", "test") for v in rng.normal(0, 1, 200)]
    df = spark.createDataFrame(rows, "fold int, role string, x double, a double, b double, actual double")
    got = blend.fold_gates(df, ["x"], "a", "b", 2).toPandas()
    # what favours the first forecast is opposite in the two folds: a shared gate could not follow
    for f, sign in ((1, 1), (2, -1)):
        own = got[got.fold == f]
        assert len(own) == 200 and own.alpha[sign * own.x > 0.5].min() > 0.5 > own.alpha[sign * own.x < -0.5].max()


def test_chunk_defaults_bound_replication():
    assert chunk_size(10) == 2048 and chunk_size(1300) == 10400
