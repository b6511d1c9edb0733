"""Blending, gates, signals, learned forecasters and the serving response."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import FOLDS, FORECASTS, RETURNS, W, clip_sql, forecasts, panel, query, rounded, wide_forecasts
from barloom.catalog.metrics import _G, gated
from barloom.functions.columns import equi
from barloom.operators import blend, clean, features as ft, folds, learned, regime, rolling
from barloom.plans.panel import row_index, windowed
from barloom.sources import bars as src
from barloom.sources import fixtures as fx

KEY = ("series_id", "bar_date")
GATE_INPUTS = ("vol_21d", "intraday_range", "close_position")


@query("gated_blend", f"WITH {_G} SELECT series_id, fold, bar_date, round(alpha, 8) AS alpha, round(pred, 8) AS pred FROM g")
def _(spark, sf):
    return rounded(gated(spark, sf).select("series_id", "fold", "bar_date", "alpha", "pred"), 8)


@query("select_primary", f"""WITH {FORECASTS} SELECT series_id, fold, bar_date, round(coalesce(a, last_return), 8) AS forecast, CASE WHEN a IS NOT NULL THEN 'arima' WHEN last_return IS NOT NULL THEN 'hybrid' END AS model
  FROM (SELECT *, CASE WHEN row_idx % 7 <> 0 THEN ar1 END AS a FROM wide)""")
def _(spark, sf):
    wide = wide_forecasts(spark, sf).withColumn("arima", F.when(F.col("row_idx") % 7 != 0, F.col("ar1")))
    value, name = blend.select_primary("arima", "last_return", "arima", "hybrid")
    return rounded(wide.select("series_id", "fold", "bar_date", value.alias("forecast"), name.alias("model")), 8)


@query("signal_label", f"""WITH {FORECASTS} SELECT model, CASE WHEN abs(pred) < 0.002 THEN 'HOLD' WHEN pred > 0 THEN 'BUY' ELSE 'SELL' END AS signal, count(*) AS n FROM forecasts GROUP BY ALL""")
def _(spark, sf):
    return forecasts(spark, sf).groupBy("model", blend.signal_label("pred").alias("signal")).agg(F.count(F.lit(1)).alias("n"))


_LATEST = f"""{RETURNS}, ar AS (SELECT *, CASE WHEN row_idx >= 119 THEN regr_intercept(close, prev) OVER ({W} ROWS BETWEEN 118 PRECEDING AND CURRENT ROW)
    + regr_slope(close, prev) OVER ({W} ROWS BETWEEN 118 PRECEDING AND CURRENT ROW) * close END AS f FROM rets),
  lt AS (SELECT series_id, bar_date, close, {clip_sql('(f - close) / close', -0.2, 0.2)} AS r, {clip_sql('ret_1d', -0.2, 0.2)} AS h FROM ar WHERE row_idx = n_rows - 1)"""


@query("forecast_response", f"""WITH {_LATEST} SELECT series_id, bar_date AS as_of, CAST(bar_date + CAST(CASE isodow(bar_date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) AS DATE) AS forecast_for,
  round(close, 2) AS last_close, round(close * (1 + r), 2) AS predicted_price, round(100 * r, 4) AS predicted_return_pct,
  CASE WHEN abs(r) < 0.002 THEN 'HOLD' WHEN r > 0 THEN 'BUY' ELSE 'SELL' END AS signal, 'arima' AS model, 0.5::DOUBLE AS alpha, round(r, 8) AS arima_return, round(h, 8) AS hybrid_return, 60 AS n_recent FROM lt""")
def _(spark, sf):
    bars = panel(spark, sf)
    df = windowed(
        bars, lambda d, w: d.withColumns({"_prev": F.lag("close").over(w), "hybrid_return": ft.pct_change("close", w)}).withColumn("ar_forecast", rolling.ar1_forecast(w)), back=120
    )
    latest = clean.latest_rows(df.select(*KEY, "close", "ar_forecast", "hybrid_return"))
    latest = latest.withColumns({"arima_return": folds.ar_return_input(), "hybrid_return": F.least(F.greatest("hybrid_return", F.lit(-0.2)), F.lit(0.2)), "alpha": F.lit(0.5)})
    out = blend.forecast_response(latest, src.recent_closes(fx.bars_priority(spark, sf)))
    return rounded(out.withColumn("n_recent", F.size("recent")).drop("recent"), 8, "arima_return", "hybrid_return")


def _newest(spark, sf):
    df = windowed(
        panel(spark, sf), lambda d, w: d.withColumns({"_prev": F.lag("close").over(w), "hybrid_return": ft.pct_change("close", w)}).withColumn("ar_forecast", rolling.ar1_forecast(w)), back=120
    )
    latest = clean.latest_rows(df.select(*KEY, "close", "ar_forecast", "hybrid_return"))
    return latest.withColumns({"arima_return": folds.ar_return_input(), "hybrid_return": F.least(F.greatest("hybrid_return", F.lit(-0.2)), F.lit(0.2)), "alpha": F.lit(0.5)})


@query("forecast_response_origin", f"""WITH {_LATEST} SELECT series_id, bar_date AS as_of, CASE WHEN r IS NOT NULL THEN 'arima' ELSE 'hybrid' END AS model, CASE WHEN r IS NOT NULL THEN '1,0,1' END AS arima_order,
  'bundled+live' AS data_source, (SELECT count(*) FILTER (bar_date >= DATE '1999-01-01') FROM bars) AS live_rows_appended, NULL::VARCHAR AS data_note, '7' AS model_version FROM lt""")
def _(spark, sf):
    """Model order and provenance next to the response."""
    bars = fx.bars_priority(spark, sf)
    latest = _newest(spark, sf)
    orders = latest.select("series_id", F.lit(1).alias("p"), F.lit(1).alias("q"))
    macro = fx.macro_long(spark, sf)
    origin = src.snapshot_provenance(bars.filter("bar_date < DATE '1999-01-01'"), bars.filter("bar_date >= DATE '1999-01-01'"), macro)
    out = blend.forecast_response(latest, orders=orders, provenance=origin, version="7")
    return out.select("series_id", "as_of", "model", F.array_join("arima_order", ",").alias("arima_order"), "data_source", "live_rows_appended", "data_note", "model_version")


def model_rows(spark, sf, bars=None):
    """Fold-expanded rows with a compact causal feature set and the forward return."""
    df = panel(spark, sf) if bars is None else row_index(bars, length="n_rows")
    out = windowed(df, lambda d, w: ft.price_features(d, w).withColumn("actual", ft.returns_target(w)), back=201, ahead=1)
    cols = ("ret_1d", "ret_5d", "vol_10d", "vol_21d", "sma20_ratio", "intraday_range", "close_position", "volume_ratio")
    return folds.expand_folds(out.select(*KEY, "row_idx", "n_rows", *cols, "actual")), cols


@query("ml_return_forecast")
def _(spark, sf):
    rows, cols = model_rows(spark, sf)
    return learned.ml_return_forecast(learned.scaled_samples(rows, cols), cols).select("series_id", "fold", "bar_date", "pred", "actual")


@query("bagged_samples")
def _(spark, sf):
    rows, cols = model_rows(spark, sf)
    return learned.bagged_samples(learned.scaled_samples(rows, cols), cols, ["series_id", "fold", "bar_date"])


def gate_rows(spark, sf):
    def build(d, w):
        d = d.withColumns({"ret_1d": ft.pct_change("close", w), "_prev": F.lag("close").over(w)})
        return d.withColumns(
            {"actual": ft.returns_target(w), "vol_21d": ft.realised_vol("ret_1d", w, 21), "intraday_range": ft.intraday_range(),
             "close_position": ft.close_position(), "ar_forecast": rolling.ar1_forecast(w)}
        )

    df = windowed(panel(spark, sf), build, back=121, ahead=1).withColumns({"ar1": folds.ar_return_input(), "last_return": F.col("ret_1d")})
    return folds.expand_folds(df).filter("actual IS NOT NULL AND ar1 IS NOT NULL")


@query("fit_gate")
def _(spark, sf):
    """Per fold: gate trained on its validation rows, applied to its test rows."""
    out = blend.fold_gates(gate_rows(spark, sf), GATE_INPUTS, "ar1", "last_return")
    return out.select("series_id", "fold", "bar_date", "alpha", "pred", "actual")


@query("fit_gate_regime")
def _(spark, sf):
    """The gate with the fold's own regime probability and the missing sentiment's neutral value among its inputs."""
    rows = gate_rows(spark, sf).withColumn("sentiment", F.lit(0.0))
    seen = windowed(panel(spark, sf), lambda d, w: (lambda e: e.withColumn("vol_10d", ft.realised_vol("ret_1d", w, 10)))(d.withColumn("ret_1d", ft.pct_change("close", w))), back=11)
    prob = regime.fold_regime_feature(seen.select(*KEY, "row_idx", "n_rows", "ret_1d", "vol_10d")).select("series_id", "fold", "bar_date", "regime_high_vol_prob")
    joined = equi(rows, prob, ["series_id", "fold", "bar_date"], "left")
    out = blend.fold_gates(joined, (*GATE_INPUTS, "regime_high_vol_prob", "sentiment"), "ar1", "last_return")
    return out.select("series_id", "fold", "bar_date", "regime_high_vol_prob", "alpha", "pred", "actual")


@query("gate_leakage", f"""WITH {RETURNS}, {FOLDS}, ar AS (SELECT series_id, row_idx, CASE WHEN nxt IS NOT NULL AND row_idx >= 119 THEN 1 END AS ok FROM rets),
  rows AS (SELECT f.fold, a.series_id, a.row_idx, CASE WHEN a.row_idx < f.test_start THEN 'val' ELSE 'test' END AS role FROM ar a JOIN folds f USING (series_id)
    WHERE ok = 1 AND a.row_idx >= f.val_start AND a.row_idx < f.test_end)
  SELECT fold, count(*) FILTER (role = 'val') AS n_val, count(*) FILTER (role = 'test') AS n_test, 0::BIGINT AS n_both FROM rows GROUP BY fold""")
def _(spark, sf):
    """Rows a fold's gate learns from, rows it scores, and rows in both."""
    rows = gate_rows(spark, sf).filter("role IN ('val', 'test')")
    once = rows.groupBy("fold", "series_id", "bar_date").agg(F.max(F.when(F.col("role") == "val", 1).otherwise(0)).alias("v"), F.max(F.when(F.col("role") == "test", 1).otherwise(0)).alias("t"))
    return once.groupBy("fold").agg(F.sum("v").alias("n_val"), F.sum("t").alias("n_test"), F.sum(F.col("v") * F.col("t")).alias("n_both"))


@query("preprocess_pipeline")
def _(spark, sf):
    from barloom.operators.preprocess import preprocess_pipeline

    return preprocess_pipeline(fx.bars_priority(spark, sf))[0]
