"""Splits, folds, samples, scalers and serving inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, FOLDS, PANEL, RETURNS, W, clip_sql, over, panel, query, rounded, rsql, wide_forecasts, FORECASTS
from barloom.catalog.sources import scratch
from barloom.operators import features as ft, folds, joins, rolling
from barloom.plans.panel import row_index, windowed
from barloom.sources import bars as src
from barloom.sources import fixtures as fx

KEY = ("series_id", "bar_date")
ROLE = "CASE WHEN row_idx < val_start THEN 'train' WHEN row_idx < train_end THEN 'val' ELSE 'test' END"
EXPANDED = f"""{FOLDS}, ex AS (SELECT p.*, f.fold, {ROLE} AS role, row_idx - test_start AS test_pos, test_end FROM panel p JOIN folds f
  ON p.series_id = f.series_id AND p.row_idx < f.test_end)"""


@query("chrono_split", f"""WITH {PANEL} SELECT series_id, bar_date, CASE WHEN row_idx < floor(n_rows * 0.70::DOUBLE) THEN 'train'
  WHEN row_idx < floor(n_rows * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM panel""")
def _(spark, sf):
    return folds.chrono_split(panel(spark, sf)).select(*KEY, "split")


@query("fold_boundaries", f"WITH {BARS}, {FOLDS} SELECT series_id, n AS n_rows, fold, val_start, train_end, test_start, test_end FROM folds")
def _(spark, sf):
    return folds.fold_boundaries(fx.bars_priority(spark, sf))


@query("validation_slice", f"WITH {PANEL}, {EXPANDED} SELECT series_id, fold, role, count(*) AS n, min(row_idx) AS first_idx, max(row_idx) AS last_idx FROM ex GROUP BY ALL")
def _(spark, sf):
    return folds.expand_folds(panel(spark, sf)).groupBy("series_id", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_idx"), F.max("row_idx").alias("last_idx")
    )


@query("expand_folds", f"WITH {PANEL}, {EXPANDED} SELECT series_id, bar_date, fold, role, test_pos FROM ex")
def _(spark, sf):
    return folds.expand_folds(panel(spark, sf)).select(*KEY, "fold", "role", "test_pos")


@query("scored_rows", f"WITH {PANEL}, {EXPANDED} SELECT series_id, fold, count(*) AS n FROM ex WHERE role = 'test' AND test_pos >= 60 AND row_idx < test_end - 1 GROUP BY 1, 2")
def _(spark, sf):
    return folds.scored_rows(folds.expand_folds(panel(spark, sf)), 60).groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("n"))


_AR = f"""ar AS (SELECT *, CASE WHEN row_idx >= 119 THEN regr_intercept(close, prev) OVER ({W} ROWS BETWEEN 118 PRECEDING AND CURRENT ROW)
  + regr_slope(close, prev) OVER ({W} ROWS BETWEEN 118 PRECEDING AND CURRENT ROW) * close END AS ar_forecast FROM rets)"""


@query("rolling_ar1", f"WITH {RETURNS}, {_AR} SELECT series_id, bar_date, round(ar_forecast, 4) AS ar_forecast FROM ar")
def _(spark, sf):
    return rounded(rolling.rolling_ar1(panel(spark, sf)).select(*KEY, "ar_forecast"), 4)


@query("ar_return_input", f"WITH {RETURNS}, {_AR} SELECT series_id, bar_date, round(CASE WHEN close > 0 THEN {clip_sql('(ar_forecast - close) / close', -0.2, 0.2)} ELSE 0 END, 8) AS ar_return FROM ar")
def _(spark, sf):
    df = rolling.rolling_ar1(panel(spark, sf))
    return rounded(df.select(*KEY, folds.ar_return_input().alias("ar_return")), 8)


@query("sequence_windows", f"""WITH {RETURNS}, {_AR}, s AS (SELECT *, sum(close) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS total,
    first_value(close) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS head, prev AS tail FROM ar)
  SELECT series_id, bar_date, 60::BIGINT AS seq_len, head, tail, round(total, 2) AS total FROM s WHERE row_idx BETWEEN 60 AND n_rows - 2 AND ar_forecast IS NOT NULL""")
def _(spark, sf):
    seq = folds.sequence_windows(rolling.rolling_ar1(panel(spark, sf)), ["close", "volume"])
    return folds.valid_samples(seq).select(
        *KEY, F.size("seq").cast("long").alias("seq_len"), F.col("seq")[0]["close"].alias("head"), F.col("seq")[59]["close"].alias("tail"),
        F.round(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x["close"]), 2).alias("total"),
    )


_IN = {"vol_21d": f"CASE WHEN {over('count(ret_1d)', 21)} = 21 THEN {over('stddev_samp(ret_1d)', 21)} END", "intraday_range": clip_sql("(high - low) / close", 0, 0.2),
       "BB_Width": f"4 * {over('stddev_samp(close)', 20)} / ({over('avg(close)', 20)} + 1e-10)"}


@query("vol_inputs", f"""WITH {RETURNS}, v AS (SELECT series_id, bar_date, {', '.join(f'coalesce({clip_sql(e, 0, 1)}, 0.5) AS {n}' for n, e in _IN.items())} FROM rets)
  SELECT series_id, bar_date, round("BB_Width", 6) AS v0, round(vol_21d, 6) AS v1, round(intraday_range, 6) AS v2, round(vol_21d, 6) AS v3, round(vol_21d, 6) AS v4 FROM v""")
def _(spark, sf):
    def build(d, w):
        d = d.withColumn("ret_1d", ft.pct_change("close", w))
        return d.withColumns({"vol_21d": ft.realised_vol("ret_1d", w, 21), "intraday_range": ft.intraday_range(), "BB_Width": ft.bollinger_width("close", w)})

    df = windowed(panel(spark, sf), build, back=22).withColumn("v", folds.vol_inputs(["vol_21d", "intraday_range", "BB_Width"]))
    return rounded(df.select(*KEY, *[F.col("v")[i].alias(f"v{i}") for i in range(5)]), 6)


# --- scalers
_COLS = ("open", "high", "low", "close", "volume")


def _scale_sql(kind: str) -> str:
    a, b = ("avg", "stddev_pop({c})") if kind == "standard" else ("min", "max({c}) - min({c})")
    parts = [f"SELECT series_id, fold, '{c}' AS feature, {a}({c}) AS mean, coalesce(nullif({b.format(c=c)}, 0), 1) AS scale FROM ex WHERE role = 'train' GROUP BY ALL" for c in _COLS]
    return " UNION ALL ".join(parts)


def _train(spark, sf):
    return folds.expand_folds(panel(spark, sf)).filter("role = 'train'")


for _kind in ("standard", "minmax"):

    @query(f"{_kind}_scaler", f"WITH {PANEL}, {EXPANDED}, sc AS ({_scale_sql(_kind)}) SELECT series_id, fold, feature, round(mean, 4) AS mean, round(scale, 4) AS scale FROM sc")
    def _(spark, sf, kind=_kind):
        return rounded(folds.fit_scaler(_train(spark, sf), _COLS, ["series_id", "fold"], kind), 4)


@query("save_load_scaler", f"WITH {PANEL}, {EXPANDED}, sc AS ({_scale_sql('standard')}) SELECT series_id, fold, feature, round(mean, 4) AS mean, round(scale, 4) AS scale FROM sc")
def _(spark, sf):
    path = scratch(spark, "scaler")
    src.save_scaler(folds.fit_scaler(_train(spark, sf), _COLS, ["series_id", "fold"]), path)
    return rounded(src.load_scaler(spark, path), 4)


_SCALED = f"""sc AS ({_scale_sql('standard')}), pv AS (SELECT series_id, fold, {', '.join(f"max(mean) FILTER (feature = '{c}') AS m_{c}, max(scale) FILTER (feature = '{c}') AS s_{c}" for c in _COLS)} FROM sc GROUP BY ALL)"""


@query("apply_scaler", f"""WITH {PANEL}, {EXPANDED}, {_SCALED} SELECT series_id, bar_date, fold, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in _COLS)}
  FROM ex JOIN pv USING (series_id, fold) WHERE role <> 'train'""")
def _(spark, sf):
    ex = folds.expand_folds(panel(spark, sf))
    scaler = folds.fit_scaler(ex.filter("role = 'train'"), _COLS, ["series_id", "fold"])
    return rounded(folds.apply_scaler(ex.filter("role <> 'train'"), scaler, _COLS, ["series_id", "fold"]).select(*KEY, "fold", *_COLS), 6)


@query("inverse_scale", f"WITH {PANEL}, {EXPANDED} SELECT series_id, bar_date, fold, round(close, 4) AS close FROM ex WHERE role = 'test'")
def _(spark, sf):
    ex = folds.expand_folds(panel(spark, sf))
    by = ["series_id", "fold"]
    scaler = folds.fit_scaler(ex.filter("role = 'train'"), ["close"], by)
    scaled = folds.apply_scaler(ex.filter("role = 'test'"), scaler, ["close"], by)
    return rounded(folds.inverse_scale(scaled, scaler, "close", "close", by).select(*KEY, "fold", "close"), 4)


@query("inverse_predictions", f"WITH {PANEL} SELECT series_id, bar_date, round(close, 4) AS level FROM panel")
def _(spark, sf):
    """Scaled first differences back to levels: must rebuild the closes."""
    df = panel(spark, sf)
    d = windowed(df, lambda x, w: x.withColumn("diff", F.coalesce(ft.difference("close", w), F.lit(0.0))), back=1)
    scaler = folds.fit_scaler(d, ["diff"], ["series_id"])
    preds = folds.apply_scaler(d, scaler, ["diff"], ["series_id"]).withColumnRenamed("diff", "pred")
    origin = df.groupBy("series_id").agg(F.min_by("close", "row_idx").alias("origin"))
    out = folds.inverse_predictions(preds.join(origin, "series_id"), scaler, "diff", "origin", ["series_id"])
    return rounded(out.select(*KEY, "level"), 4)


@query("period_slices", f"""WITH {BARS}, q AS (SELECT *, CAST(date_trunc('quarter', bar_date) AS DATE) AS period FROM bars)
  SELECT series_id, bar_date, period, count(*) OVER (PARTITION BY series_id, period) AS period_rows,
    bar_date < max(bar_date) OVER (PARTITION BY series_id, period) AS scored FROM q""")
def _(spark, sf):
    return folds.period_slices(fx.bars_priority(spark, sf)).select(*KEY, "period", "period_rows", "scored")


@query("serving_parity_check", f"WITH {PANEL} SELECT series_id, 0::BIGINT AS mismatches, count(*) AS n FROM panel WHERE row_idx < n_rows - 40 GROUP BY 1")
def _(spark, sf):
    """Features from history cut 40 rows early equal the full-history features of the same rows."""
    from barloom.plans.panel import IDX

    def feats(bars):
        idx = row_index(bars, length="n")
        out = windowed(idx, lambda d, w: ft.price_features(d, w), back=201)
        cols = ("ret_21d", "vol_21d", "sma50_ratio", "BB_Width", "ROC")
        return out.select("series_id", IDX, *[F.coalesce(F.round(c, 9), F.lit(-9.0)).alias(c) for c in cols])

    full = panel(spark, sf)
    cut = full.filter("row_idx < n_rows - 40").drop("row_idx", "n_rows")
    early, late = feats(cut), feats(full.drop("row_idx", "n_rows"))
    on = early.columns
    hit = early.join(late.withColumn("_hit", F.lit(1)), on, "left")
    return hit.groupBy("series_id").agg(F.count_if(F.col("_hit").isNull()).alias("mismatches"), F.count(F.lit(1)).alias("n"))


@query("align_forecasts", f"WITH {FORECASTS} SELECT series_id, fold, bar_date, round(persistence, 8) AS persistence, round(last_return, 8) AS last_return, round(ar1, 8) AS ar1, round(actual, 8) AS actual, 0::DOUBLE AS max_gap FROM wide")
def _(spark, sf):
    wide = wide_forecasts(spark, sf)
    parts = {m: wide.select("series_id", "fold", "bar_date", F.col(m).alias("pred"), "actual") for m in ("persistence", "last_return", "ar1")}
    out = joins.require_aligned(joins.align_forecasts(parts, ["series_id", "fold", "bar_date"]))
    return rounded(out, 8)


_SERVED = ("ret_1d", "vol_21d", "intraday_range")


@query("serving_inputs", f"""WITH {RETURNS}, f AS (SELECT *, {clip_sql('ret_1d', -1e9, 1e9)} AS r1, CASE WHEN count(ret_1d) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) = 21
    THEN stddev_samp(ret_1d) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) END AS v21, least(greatest((high - low) / close, 0), 0.2) AS rg FROM rets),
  sc AS (SELECT series_id, avg(r1) AS m1, stddev_pop(r1) AS s1, avg(v21) AS m2, stddev_pop(v21) AS s2, avg(rg) AS m3, stddev_pop(rg) AS s3 FROM f WHERE row_idx < n_rows * 0.8::DOUBLE GROUP BY 1),
  z AS (SELECT f.series_id, row_idx, n_rows, close, prev, (r1 - m1) / s1 AS z1, (v21 - m2) / s2 AS z2, (rg - m3) / s3 AS z3 FROM f JOIN sc USING (series_id)),
  q AS (SELECT series_id, sum(z1 * (row_idx - n_rows + 62)) AS q1, sum(z2 * (row_idx - n_rows + 62)) AS q2, sum(z3 * (row_idx - n_rows + 62)) AS q3 FROM z WHERE row_idx BETWEEN n_rows - 61 AND n_rows - 2 GROUP BY 1)
  SELECT series_id, round(q1, 6) AS seq_1, round(q2, 6) AS seq_2, round(q3, 6) AS seq_3, round(least(greatest(z2, 0), 1), 8) AS vol_1, round(least(greatest(z3, 0), 1), 8) AS vol_2, round(least(greatest(z1, 0), 1), 8) AS vol_pad,
    round(least(greatest((prev - close) / close, -0.2), 0.2), 8) AS ar_return, 60 AS n_seq, 0::BIGINT AS differing FROM z JOIN q USING (series_id) WHERE row_idx = n_rows - 1""")
def _(spark, sf):
    """Scaled inputs of the newest rows from their last 61 rows alone, and in how many they differ from the training rows'."""
    rows = windowed(panel(spark, sf), lambda d, w: d.withColumns({"ret_1d": ft.pct_change("close", w), "intraday_range": ft.intraday_range(), "ar_forecast": F.lag("close").over(w)}), back=1)
    rows = windowed(rows, lambda d, w: d.withColumn("vol_21d", ft.realised_vol("ret_1d", w, 21)), back=21)
    scaler = folds.fit_scaler(rows.filter("row_idx < n_rows * 0.8D"), _SERVED, ["series_id"])
    names = ["series_id", "row_idx", "seq", "vol_inputs", "ar_return"]
    served = folds.serving_inputs(rows, _SERVED, scaler, ["series_id"]).select(*names)
    trained = folds.model_inputs(rows, _SERVED, scaler, ["series_id"]).filter("row_idx = n_rows - 1").select(*names)
    differing = served.exceptAll(trained).groupBy("series_id").agg(F.count(F.lit(1)).alias("differing"))
    weighed = lambda c: F.aggregate(F.transform("seq", lambda x, i: x[c] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    out = served.join(differing, "series_id", "left").select(
        "series_id", *[weighed(c).alias(f"seq_{k}") for k, c in enumerate(_SERVED, 1)], F.col("vol_inputs")[0].alias("vol_1"), F.col("vol_inputs")[1].alias("vol_2"), F.col("vol_inputs")[4].alias("vol_pad"),
        "ar_return", F.size("seq").alias("n_seq"), F.coalesce("differing", F.lit(0).cast("bigint")).alias("differing"),
    )
    return rounded(rounded(out, 6, "seq_1", "seq_2", "seq_3"), 8, "vol_1", "vol_2", "vol_pad", "ar_return")
