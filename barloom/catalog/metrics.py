"""Forecast metrics, backtests, significance tests and stability checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import FORECASTS, forecasts, query, rounded, rsql, wide_forecasts
from barloom.operators import folds, metrics as mt, report, stats
from barloom.plans.panel import row_index
from barloom.sources import fixtures as fx

SF = ["series_id", "fold", "model"]
_E = "(pred - actual)"
METRICS = {
    "mse": f"avg({_E} * {_E})", "rmse": f"sqrt(avg({_E} * {_E}))", "mae": f"avg(abs({_E}))", "mape_pct": f"100 * avg(abs({_E} / (abs(actual) + 1e-8)))",
    "directional_accuracy": "avg(CAST(sign(pred) = sign(actual) AS DOUBLE))",
    "ic": "CASE WHEN stddev_pop(pred) > 1e-9 AND stddev_pop(actual) > 1e-9 THEN corr(pred, actual) ELSE 0 END",
    "sharpe_naive": "CASE WHEN stddev_pop(sign(pred) * actual) > 1e-9 THEN sqrt(252) * avg(sign(pred) * actual) / stddev_pop(sign(pred) * actual) ELSE 0 END",
}
M_SQL = "count(*) AS n, " + rsql(6, **{k: v for k, v in METRICS.items() if k != "mape_pct"}) + ", round(" + METRICS["mape_pct"] + ", 1) AS mape_pct"


def _r(df):
    return rounded(rounded(df, 6, *[c for c in METRICS if c != "mape_pct"]), 1, "mape_pct")


@query("forecast_metrics", f"WITH {FORECASTS} SELECT series_id, fold, model, {M_SQL} FROM forecasts GROUP BY ALL")
def _(spark, sf):
    return _r(mt.forecast_metrics(forecasts(spark, sf), SF))


@query("metric_report", f"WITH {FORECASTS} SELECT model, fold, {M_SQL} FROM forecasts GROUP BY GROUPING SETS ((model, fold), (model))")
def _(spark, sf):
    return _r(mt.metric_report(forecasts(spark, sf)))


for _name, _cols in {
    "mse_rmse_mae": ("mse", "rmse", "mae"), "mape": ("mape_pct",), "directional_accuracy": ("directional_accuracy",), "information_coefficient": ("ic",), "sharpe_naive": ("sharpe_naive",),
}.items():

    @query(_name, f"WITH {FORECASTS} SELECT series_id, model, {', '.join(f'round({METRICS[c]}, {1 if c == 'mape_pct' else 6}) AS {c}' for c in _cols)} FROM forecasts GROUP BY ALL")
    def _(spark, sf, cols=_cols):
        return _r(mt.forecast_metrics(forecasts(spark, sf), ["series_id", "model"])).select("series_id", "model", *cols)


def indexed(spark, sf, keys=("series_id", "fold", "model"), models=("last_return", "ar1")):
    """Forecasts with a contiguous row position per key."""
    f = forecasts(spark, sf).filter(F.col("model").isin(*models)).drop("row_idx")
    return row_index(f, keys, "bar_date")


_SW = "PARTITION BY series_id, fold, model ORDER BY bar_date"
_F2 = f"{FORECASTS}, fm AS (SELECT *, row_number() OVER ({_SW}) - 1 AS k FROM forecasts WHERE model <> 'persistence')"
_AGREE = f"""ag AS (SELECT *, CAST((pred - lag(pred) OVER ({_SW}) > 0) = (actual - lag(actual) OVER ({_SW}) > 0) AS DOUBLE) AS agree FROM fm)"""


@query("directional_accuracy_diff", f"WITH {_F2}, {_AGREE} SELECT series_id, fold, model, count(agree) AS n_moves, round(100 * avg(agree), 6) AS accuracy_pct FROM ag GROUP BY ALL")
def _(spark, sf):
    return rounded(mt.directional_accuracy_diff(indexed(spark, sf), SF), 6)


_STRAT = f"""st AS (SELECT *, sign(pred) * actual - CASE WHEN sign(pred) <> coalesce(lag(sign(pred)) OVER ({_SW}), 0) THEN 0.001::DOUBLE ELSE 0 END AS strat FROM fm)"""


@query("strategy_returns", f"WITH {_F2}, {_STRAT} SELECT series_id, bar_date, fold, model, round(strat, 8) AS strat FROM st")
def _(spark, sf):
    return rounded(mt.strategy_returns(indexed(spark, sf), SF).select("series_id", "bar_date", "fold", "model", "strat"), 8)


_PATH = f"""{_STRAT}, eq AS (SELECT *, product(1 + strat) OVER ({_SW} ROWS UNBOUNDED PRECEDING) AS eq, product(1 + actual) OVER ({_SW} ROWS UNBOUNDED PRECEDING) AS bh FROM st),
  pk AS (SELECT *, eq / max(eq) OVER ({_SW} ROWS UNBOUNDED PRECEDING) - 1 AS dd, bh / max(bh) OVER ({_SW} ROWS UNBOUNDED PRECEDING) - 1 AS bh_dd, strat - 0.02 / 252 AS ex FROM eq)"""
_AGG = """a AS (SELECT series_id, fold, model, count(*) AS n, avg(ex) AS ex, stddev_pop(strat) AS sd, stddev_pop(ex) FILTER (ex < 0) AS dsd, min(dd) AS dd, arg_max(eq, k) AS last,
  100 * avg(CAST(strat > 0 AS DOUBLE)) AS win, coalesce(sum(strat) FILTER (strat > 0), 0) AS gain, abs(coalesce(sum(strat) FILTER (strat < 0), 0)) AS loss,
  avg(actual) AS bh, stddev_pop(actual) AS bh_sd, min(bh_dd) AS bh_dd FROM pk GROUP BY ALL),
  b AS (SELECT *, pow(last, 252.0::DOUBLE / n) - 1 AS ann FROM a)"""
_BT = {
    "sharpe": ("CASE WHEN sd > 1e-9 THEN sqrt(252) * ex / sd ELSE 0 END", 6), "sortino": ("CASE WHEN dsd > 1e-9 THEN sqrt(252) * ex / dsd ELSE 0 END", 6),
    "max_drawdown": ("dd", 6), "annual_return": ("sign(ann) * ln(1 + abs(ann))", 6), "calmar": ("CASE WHEN abs(dd) > 1e-9 THEN sign(ann) * ln(1 + abs(ann / dd)) ELSE 0 END", 6),
    "win_rate_pct": ("win", 6), "profit_factor": ("CASE WHEN loss > 1e-9 THEN gain / loss ELSE 'inf'::DOUBLE END", 6),
    "bh_sharpe": ("sqrt(252) * (bh - 0.02 / 252) / (bh_sd + 1e-9)", 6), "bh_max_drawdown": ("bh_dd", 6),
}
for _name, _cols in {
    "backtest": tuple(_BT), "sharpe_sortino": ("sharpe", "sortino"), "max_drawdown": ("max_drawdown",), "annual_return_calmar": ("annual_return", "calmar"),
    "win_rate_profit_factor": ("win_rate_pct", "profit_factor"), "buy_and_hold": ("bh_sharpe", "bh_max_drawdown"),
}.items():

    @query(_name, f"WITH {_F2}, {_PATH}, {_AGG} SELECT series_id, fold, model, n, {', '.join(f'round({_BT[c][0]}, {_BT[c][1]}) AS {c}' for c in _cols)} FROM b")
    def _(spark, sf, cols=_cols):
        # the two growth ratios span many magnitudes here, so they are compared on a signed log scale
        out = mt.backtest(indexed(spark, sf), SF)
        out = out.withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in ("annual_return", "calmar")})
        return rounded(out, 6).select(*SF, "n", *cols)


@query("drawdown_path", f"WITH {_F2}, {_PATH} SELECT series_id, fold, model, k AS row_idx, round(eq, 6) AS equity_strat, round(dd, 6) AS drawdown_strat FROM pk")
def _(spark, sf):
    path = mt.drawdown_path(mt.strategy_returns(indexed(spark, sf), SF), ["strat"], SF)
    return rounded(path.select(*SF, "row_idx", "equity_strat", "drawdown_strat"), 6)


_ALPHA = "1 / (1 + exp(-(abs(last_return) - abs(ar1)) * 10))"


def gated(spark, sf):
    """Wide forecasts with a gate driven by the two forecast sizes and the blended forecast."""
    from barloom.functions.columns import sigmoid
    from barloom.operators.blend import gated_blend

    wide = wide_forecasts(spark, sf).withColumn("alpha", sigmoid((F.abs("last_return") - F.abs("ar1")) * 10.0))
    return wide.withColumn("pred", gated_blend("alpha", "ar1", "last_return"))


_G = f"{FORECASTS}, g0 AS (SELECT *, {_ALPHA} AS alpha FROM wide), g AS (SELECT *, alpha * ar1 + (1 - alpha) * last_return AS pred FROM g0)"


@query("gate_stats", f"""WITH {_G} SELECT series_id, fold, {rsql(6, alpha_mean='avg(alpha)', alpha_std='stddev_pop(alpha)', alpha_min='min(alpha)', alpha_max='max(alpha)')},
  stddev_pop(alpha) > 1e-3 AS is_active, min(alpha) >= 0 AND max(alpha) <= 1 AS in_range FROM g GROUP BY ALL""")
def _(spark, sf):
    return rounded(mt.gate_stats(gated(spark, sf), "alpha", ["series_id", "fold"]), 6)


_IC = "1 - covar_pop(pred, actual) / (stddev_samp(pred) * stddev_samp(actual) + 1e-8)"
_LT = {"ic_loss": _IC, "mse_loss": "5000 * avg((pred - actual) * (pred - actual))", "agreement_loss": "2500 * avg((pred - ar1) * (pred - ar1))", "gate_loss": "exp(-100 * var_samp(alpha))"}


@query("loss_terms", f"WITH {_G}, t AS (SELECT series_id, fold, {', '.join(f'{e} AS {n}' for n, e in _LT.items())} FROM g GROUP BY ALL) SELECT series_id, fold, {rsql(6, **{n: n for n in _LT}, total_loss='ic_loss + 0.5 * mse_loss + 0.1 * agreement_loss + 0.15 * gate_loss')} FROM t")
def _(spark, sf):
    return rounded(mt.loss_terms(gated(spark, sf), ["series_id", "fold"], ar="ar1"), 6)


@query("magnitude_stats", f"""WITH {FORECASTS} SELECT model, {rsql(8, **{f'{c}_{n}': f'{f}({c})' for c in ('pred', 'actual') for n, f in (('mean', 'avg'), ('std', 'stddev_pop'), ('min', 'min'), ('max', 'max'))})},
  stddev_pop(pred) > 1e-3 AS variance_ok FROM forecasts GROUP BY 1""")
def _(spark, sf):
    return rounded(mt.magnitude_stats(forecasts(spark, sf), ["model"]), 8)


_WIN = f"""wn AS (SELECT *, k // 30 AS win, CASE WHEN k % 30 <> 0 THEN agree END AS a30 FROM ag),
  w2 AS (SELECT series_id, fold, model, win, 100 * avg(a30) AS acc FROM wn GROUP BY ALL HAVING count(*) = 30)"""


@query("rolling_stability", f"""WITH {_F2}, {_AGREE}, {_WIN} SELECT series_id, fold, model, count(*) AS n_windows, {rsql(6, mean_accuracy='avg(acc)', std_accuracy='stddev_pop(acc)', min_accuracy='min(acc)', max_accuracy='max(acc)')},
  stddev_pop(acc) < 15 AS is_stable FROM w2 GROUP BY ALL""")
def _(spark, sf):
    return rounded(mt.rolling_stability(indexed(spark, sf), SF), 6)


@query("consistency_check", f"WITH {FORECASTS} SELECT series_id, count(*) AS n, 0::BIGINT AS unmatched, 0::DOUBLE AS max_std, true AS consistent FROM forecasts WHERE model = 'ar1' GROUP BY 1")
def _(spark, sf):
    """The same rows scored twice, once over small chunks."""
    from barloom.operators import rolling
    from barloom.plans.panel import windowed
    from barloom.catalog.base import panel
    from barloom.operators.folds import ar_return_input

    again = windowed(
        panel(spark, sf), lambda d, w: d.withColumn("_prev", F.lag("close").over(w)).withColumn("ar_forecast", rolling.ar1_forecast(w)), back=120, size=300
    ).withColumn("pred", ar_return_input())
    first = forecasts(spark, sf).filter("model = 'ar1'")
    second = again.join(first.select("series_id", "bar_date"), ["series_id", "bar_date"], "left_semi")
    return rounded(mt.consistency_check(first, second, ["series_id", "bar_date"], ["series_id"]), 9)


@query("noise_sensitivity")
def _(spark, sf):
    score = lambda c: 0.7 * c["last_return"] + 0.3 * c["ar1"]
    return mt.noise_sensitivity(wide_forecasts(spark, sf), ["last_return", "ar1"], score, ["series_id"])


_PER = f"""{FORECASTS}, pd AS (SELECT *, CAST(date_trunc('quarter', bar_date) AS DATE) AS period FROM forecasts),
  ps AS (SELECT model, period, count(*) AS n, sqrt(avg({_E} * {_E})) AS rmse, avg(abs({_E})) AS mae, 100 * avg(CAST(sign(pred) = sign(actual) AS DOUBLE)) AS da FROM pd GROUP BY ALL)"""


@query("period_summary", f"WITH {_PER} SELECT model, period, n, {rsql(6, rmse='rmse', mae='mae', directional_accuracy='da')} FROM ps")
def _(spark, sf):
    return rounded(mt.period_summary(forecasts(spark, sf).withColumn("period", F.trunc("bar_date", "quarter")), ["model"]), 6)


@query("across_periods", f"WITH {_PER} SELECT model, count(*) AS n_periods, {rsql(6, mean_accuracy='avg(da)', std_accuracy='stddev_pop(da)', mean_rmse='avg(rmse)')} FROM ps GROUP BY 1")
def _(spark, sf):
    per = mt.period_summary(forecasts(spark, sf).withColumn("period", F.trunc("bar_date", "quarter")), ["model"])
    return rounded(mt.across_periods(per, ["model"]), 6)


@query("confusion_matrix", f"""WITH {FORECASTS} SELECT series_id, model, count(*) FILTER (pred > 0 AND actual > 0) AS tp, count(*) FILTER (pred > 0 AND actual <= 0) AS fp,
  count(*) FILTER (pred <= 0 AND actual > 0) AS fn, count(*) FILTER (pred <= 0 AND actual <= 0) AS tn FROM forecasts GROUP BY ALL""")
def _(spark, sf):
    return mt.confusion_matrix(forecasts(spark, sf), ["series_id", "model"])


@query("direction_counts", f"WITH {FORECASTS} SELECT model, fold, count(*) FILTER (sign(pred) = sign(actual)) AS n_correct, count(*) AS n FROM forecasts GROUP BY ALL")
def _(spark, sf):
    return stats.direction_counts(forecasts(spark, sf), ["model", "fold"])


# upper tail P(X >= k) at success probability p, as a sum of terms; the interval's ends are found by bisection
_TAIL = lambda k, p: f"list_sum(list_transform(range({k}, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - ({p})))))"


@query("binomial_test", f"""WITH RECURSIVE {FORECASTS}, c AS (SELECT model, count(*) FILTER (sign(pred) = sign(actual)) AS n_correct, count(*) AS n FROM forecasts GROUP BY ALL),
  b AS (SELECT *, 0 AS step, 0::DOUBLE AS l0, 1::DOUBLE AS l1, 0::DOUBLE AS h0, 1::DOUBLE AS h1 FROM c
    UNION ALL SELECT model, n_correct, n, step + 1, CASE WHEN tl < 0.025 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN tl < 0.025 THEN l1 ELSE (l0 + l1) / 2 END,
      CASE WHEN th < 0.975 THEN (h0 + h1) / 2 ELSE h0 END, CASE WHEN th < 0.975 THEN h1 ELSE (h0 + h1) / 2 END
    FROM (SELECT *, {_TAIL('n_correct', '(l0 + l1) / 2')} AS tl, coalesce({_TAIL('n_correct + 1', '(h0 + h1) / 2')}, 0) AS th FROM b WHERE step < 45))
  SELECT model, n_correct, n, {rsql(6, p_two_sided=f"least(1, 2 * {_TAIL('greatest(n_correct, n - n_correct)', '0.5::DOUBLE')})", p_greater=_TAIL('n_correct', '0.5::DOUBLE'))},
    round(CASE WHEN n_correct = 0 THEN 0 ELSE (l0 + l1) / 2 END, 6) AS ci_low, round(CASE WHEN n_correct = n THEN 1 ELSE (h0 + h1) / 2 END, 6) AS ci_high FROM b WHERE step = 45""")
def _(spark, sf):
    return rounded(stats.binomial_test(forecasts(spark, sf), ["model"]), 6)


def _dm_sql(h: int, loss: str) -> str:
    size = (lambda e: f"({e}) * ({e})") if loss == "squared" else (lambda e: f"abs({e})")
    w = "PARTITION BY series_id, fold ORDER BY bar_date"
    lags = "".join(f", lag(d, {k}) OVER ({w}) AS d{k}" for k in range(1, h))
    var = "var_pop(d)" + "".join(f" + {2 * (1 - k / h)!r}::DOUBLE * covar_samp(d, d{k})" for k in range(1, h))
    return f"""WITH {FORECASTS}, l AS (SELECT *, {size('actual - ar1')} AS l1, {size('actual - last_return')} AS l2 FROM wide),
      d0 AS (SELECT *, l1 - l2 AS d FROM l), d1 AS (SELECT *{lags} FROM d0)
      SELECT series_id, fold, count(*) AS n, round(avg(d) / sqrt(greatest({var}, 1e-300) / count(*)) * sqrt((count(*) + 1 - {2 * h} + {h * (h - 1)}.0::DOUBLE / count(*)) / count(*)), 6) AS dm_statistic,
        round(avg(l1), 8) AS mean_loss_model1, round(avg(l2), 8) AS mean_loss_model2 FROM d1 GROUP BY ALL"""


def _dm(spark, sf, h, loss):
    wide = row_index(wide_forecasts(spark, sf).drop("row_idx"), ["series_id", "fold"], "bar_date")
    return stats.dm_statistic(wide, "ar1", "last_return", ["series_id", "fold"], h, loss)


for _h, _loss in ((1, "squared"), (3, "absolute")):

    @query(f"diebold_mariano_h{_h}_{_loss}", _dm_sql(_h, _loss))
    def _(spark, sf, h=_h, loss=_loss):
        return rounded(rounded(_dm(spark, sf, h, loss), 6, "dm_statistic"), 8, "mean_loss_model1", "mean_loss_model2")


# Student's t by the finite sums for whole degrees of freedom
_T_INSIDE = """CASE WHEN f % 2 = 0 THEN sin(a) * (1 + coalesce(list_sum(list_transform(range(1, f // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2) + 2 * k * ln(cos(a))))), 0))
  ELSE 2 / pi() * (a + CASE WHEN f > 1 THEN sin(a) * cos(a) * (1 + coalesce(list_sum(list_transform(range(1, (f - 1) // 2), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + 2 * k * ln(cos(a))))), 0)) ELSE 0 END) END"""


@query("diebold_mariano_test", f"""WITH {FORECASTS}, l AS (SELECT fold, (actual - ar1) * (actual - ar1) AS l1, (actual - persistence) * (actual - persistence) AS l2 FROM wide WHERE ar1 IS NOT NULL),
  g AS (SELECT fold, count(*) AS n, avg(l1 - l2) / sqrt(greatest(var_pop(l1 - l2), 1e-300) / count(*)) * sqrt((count(*) - 1) / count(*)::DOUBLE) AS t, avg(l1) AS m1, avg(l2) AS m2 FROM l GROUP BY 1),
  p AS (SELECT *, 1 - ({_T_INSIDE}) AS p FROM (SELECT *, n - 1 AS f, atan(abs(t) / sqrt(n - 1)) AS a FROM g))
  SELECT fold, n, {rsql(6, dm_statistic='t', p_value='p')}, {rsql(8, mean_loss_model1='m1', mean_loss_model2='m2')}, 'squared' AS loss_function, 1 AS horizon,
    CASE WHEN p < 0.05 AND t < 0 THEN 'model1' WHEN p < 0.05 AND t > 0 THEN 'model2' ELSE 'neither' END AS better FROM p""")
def _(spark, sf):
    out = stats.diebold_mariano(wide_forecasts(spark, sf).filter("ar1 IS NOT NULL"), "ar1", "persistence", ["fold"])
    better = F.when(F.col("interpretation").startswith("model"), F.substring("interpretation", 1, 6)).otherwise("neither")
    return rounded(rounded(out.withColumn("better", better).drop("interpretation"), 6, "dm_statistic", "p_value"), 8, "mean_loss_model1", "mean_loss_model2")


@query("walk_forward_summary", f"""WITH {FORECASTS} SELECT series_id, fold, model, {rsql(6, mse=METRICS['mse'], mae=METRICS['mae'], directional_accuracy=METRICS['directional_accuracy'])}, count(*) AS n
  FROM forecasts GROUP BY GROUPING SETS ((series_id, fold, model), (series_id, model))""")
def _(spark, sf):
    out = mt.metric_report(forecasts(spark, sf), ("series_id", "model"))
    return rounded(out.select("series_id", "fold", "model", "mse", "mae", "directional_accuracy", "n"), 6)


_REPORT_DM = lambda other: f"avg(d_{other}) / sqrt(greatest(var_pop(d_{other}), 1e-300) / count(*)) * sqrt((count(*) - 1) / count(*)::DOUBLE)"


@query("walk_forward_report", f"""WITH {FORECASTS}, h AS (SELECT *, 0.25::DOUBLE + (row_idx % 3) * 0.25::DOUBLE AS alpha FROM wide WHERE ar1 IS NOT NULL AND last_return IS NOT NULL),
  b AS (SELECT *, alpha * ar1 + (1 - alpha) * last_return AS hybrid FROM h),
  d AS (SELECT *, (actual - hybrid) * (actual - hybrid) - (actual - ar1) * (actual - ar1) AS d_ar1, (actual - hybrid) * (actual - hybrid) - (actual - persistence) * (actual - persistence) AS d_persistence FROM b),
  r AS (SELECT series_id, fold, count(*) AS n, {', '.join(f'avg((actual - {m}) * (actual - {m})) AS mse_{m}, avg(abs(actual - {m})) AS mae_{m}, avg(CAST(sign({m}) = sign(actual) AS DOUBLE)) AS da_{m}' for m in ('hybrid', 'ar1', 'persistence'))},
    {_REPORT_DM('ar1')} AS dm_ar1, {_REPORT_DM('persistence')} AS dm_persistence, count(*) FILTER (sign(hybrid) = sign(actual)) AS n_correct, avg(alpha) AS alpha_mean, stddev_pop(alpha) AS alpha_std
    FROM d GROUP BY GROUPING SETS ((series_id, fold), (series_id)))
  SELECT r.series_id, r.fold, r.n, {', '.join(f'round({k}_{m}, 8) AS {k}_{m}' for m in ('hybrid', 'ar1', 'persistence') for k in ('mse', 'mae', 'da'))}, round(dm_ar1, 6) AS dm_ar1, round(dm_persistence, 6) AS dm_persistence,
    n_correct, round(alpha_mean, 8) AS alpha_mean, round(alpha_std, 8) AS alpha_std, f.test_start, f.test_end FROM r LEFT JOIN folds f ON f.series_id = r.series_id AND f.fold = r.fold""")
def _(spark, sf):
    """The report on a pinned blend, the rolling AR forecast and persistence."""
    weight = 0.25 + (F.col("row_idx") % 3) * 0.25
    wide = wide_forecasts(spark, sf).withColumn("alpha", weight).withColumn("hybrid", F.col("alpha") * F.col("ar1") + (1 - F.col("alpha")) * F.col("last_return"))
    models = ("hybrid", "ar1", "persistence")
    edges = folds.fold_boundaries(fx.bars_priority(spark, sf)).select("series_id", "fold", "test_start", "test_end")
    out = report.walk_forward_report(wide.filter("last_return IS NOT NULL"), models, alpha="alpha", boundaries=edges)
    short = {"mse": "mse", "mae": "mae", "da": "directional_accuracy"}
    flat = out.select(
        "series_id", "fold", F.col("metrics_hybrid.n").alias("n"), *[F.col(f"metrics_{m}.{c}").alias(f"{k}_{m}") for m in models for k, c in short.items()],
        *[F.col(f"dm_vs_{m}.dm_statistic").alias(f"dm_{m}") for m in models[1:]], "direction.n_correct", "gate.alpha_mean", "gate.alpha_std", "boundaries.test_start", "boundaries.test_end",
    )
    return rounded(rounded(flat, 6, "dm_ar1", "dm_persistence"), 8, "alpha_mean", "alpha_std", *[f"{k}_{m}" for m in models for k in short])
