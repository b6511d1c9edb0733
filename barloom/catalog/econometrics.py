"""Screens, order selection and rolling forecasters over the panel."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, PANEL, RETURNS, W, macro_wide, panel, query, rounded, rsql
from barloom.catalog.sources import PAIRS, neighbour_pairs
from barloom.operators import arma_css, blend, econometrics as eco, features as ft, folds, joins, rolling
from barloom.plans.panel import windowed
from barloom.sources import fixtures as fx

KEY = ("series_id", "bar_date")


def returns(spark, sf):
    return windowed(panel(spark, sf), lambda d, w: d.withColumn("ret_1d", ft.pct_change("close", w)), back=1)


@query("adf_screen")
def _(spark, sf):
    return eco.adf_screen(panel(spark, sf), "close")


@query("kpss_screen")
def _(spark, sf):
    return eco.kpss_screen(panel(spark, sf), "close")


def _kpss_sql(lags: int, trend: str) -> str:
    line = "m" if trend == "c" else "a + b * row_idx"
    cov = " + ".join(["sum(e * e)"] + [f"{2 * (1 - k / (lags + 1))!r}::DOUBLE * sum(e * lag_{k})" for k in range(1, lags + 1)])
    return f"""WITH {PANEL}, f AS (SELECT series_id, avg(close) AS m, regr_slope(close, row_idx) AS b, regr_intercept(close, row_idx) AS a FROM panel GROUP BY 1),
      r AS (SELECT p.series_id, bar_date, n_rows, close - ({line}) AS e FROM panel p JOIN f USING (series_id)),
      s AS (SELECT *, sum(e) OVER ({W} ROWS UNBOUNDED PRECEDING) AS s, {', '.join(f'lag(e, {k}) OVER ({W}) AS lag_{k}' for k in range(1, lags + 1))} FROM r)
      SELECT series_id, count(*) AS n_rows, round((sum(s * s) / (count(*) * count(*)::DOUBLE)) / (({cov}) / count(*)), 8) AS kpss_statistic FROM s GROUP BY 1"""


for _trend in ("c", "ct"):

    @query(f"kpss_statistic_{_trend}", _kpss_sql(8, _trend))
    def _(spark, sf, trend=_trend):
        return rounded(eco.kpss_screen(panel(spark, sf), "close", trend=trend, lags=8).select("series_id", "n_rows", "kpss_statistic"), 8)


def _poly(coefs) -> str:
    return " + ".join(f"({c!r}::DOUBLE) * pow(stat, {i})" for i, c in enumerate(coefs))


def _unit_roots_sql(lags: int = 8) -> str:
    """Both tests on levels, differences and second differences: Dickey-Fuller without lags, its verdict read off the response
    surface (p below 5% where the polynomial is below the normal quantile), and KPSS at a fixed bandwidth."""
    z = f"{NormalDist().inv_cdf(eco.LEVEL)!r}::DOUBLE"
    cov = " + ".join(["sum(e * e)"] + [f"{2 * (1 - k / (lags + 1))!r}::DOUBLE * sum(e * e_{k})" for k in range(1, lags + 1)])
    return f"""{PANEL}, ladder AS (SELECT series_id, 0 AS d, row_idx AS i, close AS y FROM panel UNION ALL SELECT series_id, 1, row_idx, close - lag(close) OVER ({W}) FROM panel
      UNION ALL SELECT series_id, 2, row_idx, close - 2 * lag(close) OVER ({W}) + lag(close, 2) OVER ({W}) FROM panel),
    lg AS (SELECT *, y - lag(y) OVER k AS dy, lag(y) OVER k AS y1, y - avg(y) OVER (PARTITION BY series_id, d) AS e FROM ladder WHERE y IS NOT NULL WINDOW k AS (PARTITION BY series_id, d ORDER BY i)),
    df AS (SELECT series_id, d, count(*) + 1 AS n_rows, count(*) AS nobs, regr_slope(dy, y1) / sqrt((regr_syy(dy, y1) - regr_slope(dy, y1) * regr_sxy(dy, y1)) / (count(*) - 2) / regr_sxx(dy, y1)) AS stat FROM lg WHERE dy IS NOT NULL GROUP BY 1, 2),
    adf AS (SELECT *, CASE WHEN stat > {eco.TAU_MAX[1]} THEN false WHEN stat < {eco.TAU_MIN[1]} THEN true WHEN stat <= {eco.TAU_STAR[1]} THEN {_poly(eco.TAU_SMALL[1])} < {z} ELSE {_poly(eco.TAU_LARGE[1])} < {z} END AS rejects FROM df),
    ks AS (SELECT *, sum(e) OVER (PARTITION BY series_id, d ORDER BY i ROWS UNBOUNDED PRECEDING) AS s, {', '.join(f'lag(e, {k}) OVER (PARTITION BY series_id, d ORDER BY i) AS e_{k}' for k in range(1, lags + 1))} FROM lg),
    kpss AS (SELECT series_id, d, (sum(s * s) / (count(*) * count(*)::DOUBLE)) / (({cov}) / count(*)) AS eta FROM ks GROUP BY 1, 2),
    both_ AS (SELECT series_id, d, n_rows, nobs, stat, rejects, eta < {eco.KPSS_CRIT['c'][1]}::DOUBLE AS keeps FROM adf JOIN kpss USING (series_id, d))"""


@query("adf_lag0", f"WITH {_unit_roots_sql()} SELECT series_id, n_rows, nobs, round(stat, 5) AS adf_statistic, rejects AS is_stationary FROM both_ WHERE d = 0")
def _(spark, sf):
    return rounded(eco.adf_screen(panel(spark, sf), "close", max_lag=0).select("series_id", "n_rows", "nobs", "adf_statistic", "is_stationary"), 5)


@query("consensus_fixed_lags", f"WITH {_unit_roots_sql()} SELECT series_id, rejects AS adf_stationary, keeps AS kpss_stationary, rejects AND keeps AS is_stationary FROM both_ WHERE d = 0")
def _(spark, sf):
    return eco.stationarity_consensus(panel(spark, sf), "close", max_lag=0, kpss_lags=8).drop("adf_p", "kpss_p")


@query("auto_difference_fixed_lags", f"WITH {_unit_roots_sql()} SELECT series_id, coalesce(min(CASE WHEN rejects AND keeps THEN d END), 2) AS diff_order, count(CASE WHEN rejects AND keeps THEN 1 END) > 0 AS passed FROM both_ GROUP BY 1")
def _(spark, sf):
    return eco.auto_difference(panel(spark, sf), "close", max_lag=0, kpss_lags=8)


@query("integration_order_lag0", f"WITH {_unit_roots_sql()} SELECT series_id, CASE WHEN bool_or(d = 0 AND rejects) THEN 'I(0)' WHEN bool_or(d = 1 AND rejects) THEN 'I(1)' ELSE 'I(2)+' END AS integration FROM both_ GROUP BY 1")
def _(spark, sf):
    return eco.integration_order(panel(spark, sf), "close", max_lag=0).select("series_id", "integration")


@query("stationarity_consensus")
def _(spark, sf):
    return eco.stationarity_consensus(panel(spark, sf), "close")


@query("auto_difference")
def _(spark, sf):
    return eco.auto_difference(panel(spark, sf), "close")


@query("integration_order")
def _(spark, sf):
    return eco.integration_order(panel(spark, sf), "close")


@query("rolling_ar5")
def _(spark, sf):
    return rolling.rolling_ar(panel(spark, sf)).select(*KEY, "ar_forecast", "is_fallback")


@query("ar_fallback_cap", f"WITH {PANEL} SELECT series_id, count(*) AS attempted, 0::BIGINT AS fallbacks, true AS within_cap FROM panel WHERE row_idx >= 119 GROUP BY 1")
def _(spark, sf):
    return rolling.fallback_share(rolling.rolling_ar(panel(spark, sf)))


_AR1 = f"""SELECT series_id, bar_date, round(CASE WHEN row_idx >= 251 THEN regr_intercept(close, prev) OVER f + regr_slope(close, prev) OVER f * close END, 3) AS forecast, row_idx + 1 AS target_idx
  FROM rets WINDOW f AS ({W} ROWS BETWEEN 250 PRECEDING AND CURRENT ROW)"""


@query("rolling_fit_predict", f"WITH {RETURNS} {_AR1}")
def _(spark, sf):
    """The batched solver at one lag, against windowed regressions."""
    out = rolling.rolling_fit_predict(panel(spark, sf), "close", 252, 1, 1)
    return rounded(out.select(*KEY, F.col("ar_forecast").alias("forecast"), "target_idx"), 3)


_REGRESSED = f"""SELECT series_id, bar_date, row_idx, close, volume, avg(close) OVER f AS my, avg(prev) OVER f AS m1, avg(pv) OVER f AS m2, var_pop(prev) OVER f AS s11, var_pop(pv) OVER f AS s22,
    covar_pop(prev, pv) OVER f AS s12, covar_pop(prev, close) OVER f AS s1y, covar_pop(pv, close) OVER f AS s2y
  FROM (SELECT *, lag(volume) OVER ({W}) AS pv FROM rets) WINDOW f AS ({W} ROWS BETWEEN 250 PRECEDING AND CURRENT ROW)"""


@query("rolling_fit_regressors", f"""WITH {RETURNS}, s AS ({_REGRESSED})
  SELECT series_id, bar_date, round(CASE WHEN row_idx >= 251 THEN my + ((s1y * s22 - s2y * s12) * (close - m1) + (s2y * s11 - s1y * s12) * (volume - m2)) / (s11 * s22 - s12 * s12) END, 2) AS forecast FROM s""")
def _(spark, sf):
    """Own lag and the lagged volume, against windowed covariances."""
    out = rolling.rolling_fit_predict(panel(spark, sf), "close", 252, 1, 1, regressors=["volume"])
    return rounded(out.select(*KEY, F.col("ar_forecast").alias("forecast")), 2)


@query("rolling_fit_predict_h2")
def _(spark, sf):
    return rolling.rolling_fit_predict(panel(spark, sf), "close", 252, 5, 2).select(*KEY, "ar_forecast", "target_idx")


@query("ar_order_select")
def _(spark, sf):
    return eco.ar_order_select(panel(spark, sf), "close")


@query("ar_order_select_two", f"""WITH {PANEL}, l AS (SELECT * FROM (SELECT series_id, close AS y, lag(close) OVER ({W}) AS a, lag(close, 2) OVER ({W}) AS b FROM panel) WHERE b IS NOT NULL),
  c AS (SELECT series_id, count(*) AS n, var_pop(y) AS yy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM l GROUP BY 1),
  r AS (SELECT series_id, n, n * (yy - ay * ay / aa) AS r1, n * (yy - ((ay * bb - byy * ab) * ay + (byy * aa - ay * ab) * byy) / (aa * bb - ab * ab)) AS r2 FROM c),
  i AS (SELECT series_id, n, n * (ln(2 * pi()) + ln(r1 / n) + 1) + 3 * ln(n) AS b1, n * (ln(2 * pi()) + ln(r2 / n) + 1) + 4 * ln(n) AS b2 FROM r)
  SELECT series_id, CASE WHEN b2 < b1 THEN 2 ELSE 1 END AS lags, round(least(b1, b2), 3) AS bic, n AS nobs FROM i""")
def _(spark, sf):
    """One own lag or two, by BIC on the common sample."""
    return rounded(eco.ar_order_select(panel(spark, sf), "close", max_lags=2).select("series_id", "lags", "bic", "nobs"), 3)


def with_macro(spark, sf):
    return joins.align_macro(panel(spark, sf), macro_wide(spark, sf))


@query("ardl_fit")
def _(spark, sf):
    return eco.ardl_fit(with_macro(spark, sf), "close", ["VIX"]).drop("recent")


@query("ardl_forecast")
def _(spark, sf):
    return eco.ardl_forecast(eco.ardl_fit(with_macro(spark, sf), "close", ["VIX"]), 5, 1)


def _det(m) -> str:
    return f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"


def _cramer(mat, right, k: int) -> str:
    """Unknown k of a symmetric 3 x 3 system."""
    return f"({_det([right[i // 3] if i % 3 == k else mat[i] for i in range(9)])} / {_det(mat)})"


def _trends_sql() -> str:
    """Normal equations of close on its own lag, the lagged open and, by trend, the position; centred where a constant is in."""
    parts = []
    for trend in eco.TRENDS:
        mean = "covar_pop({}, {})" if "c" in trend else "avg({} * {})"
        with_t = "t" in trend
        of = lambda a, b: (("1.0::DOUBLE" if a == b else "0.0::DOUBLE") if not with_t and "t" in (a, b) else mean.format(a, b))  # noqa: B023, E731
        names = ("t", "y1", "x1")
        cells = ", ".join(f"{of(a, b)} AS {a}_{b}" for i, a in enumerate(names) for b in names[i:])
        parts.append(f"SELECT series_id, '{trend}' AS trend, {cells}, {', '.join(f'{of(a, chr(121))} AS {a}_y' for a in names)}, avg(y) AS my, avg(t) AS mt, avg(y1) AS my1, avg(x1) AS mx1 FROM lagged GROUP BY 1")
    mat, right = ["t_t", "t_y1", "t_x1", "t_y1", "y1_y1", "y1_x1", "t_x1", "y1_x1", "x1_x1"], ["t_y", "y1_y", "x1_y"]
    return f"""{PANEL}, lagged AS (SELECT * FROM (SELECT series_id, close AS y, (row_idx + 1)::DOUBLE AS t, lag(close) OVER ({W}) AS y1, lag(open) OVER ({W}) AS x1 FROM panel) WHERE y1 IS NOT NULL),
      eq AS ({' UNION ALL '.join(parts)}),
      sol AS (SELECT *, {', '.join(f'{_cramer(mat, right, k)} AS b{k}' for k in range(3))} FROM eq),
      ardl AS (SELECT series_id, trend, b0 AS slope, b1 AS own, b2 AS other, CASE WHEN trend IN ('c', 'ct') THEN my - b0 * mt * (trend = 'ct')::INT - b1 * my1 - b2 * mx1 ELSE 0 END AS const FROM sol)"""


def _fixed_ardl(spark, sf, trend):
    return eco.ardl_fit(panel(spark, sf), "close", ["open"], fixed_order=(1, 1), trend=trend)


@query("ardl_fixed_trends", f"WITH {_trends_sql()} SELECT series_id, trend, round(const / 1000, 4) AS const, round(slope, 4) AS slope, round(own, 6) AS own, round(other, 6) AS other FROM ardl")
def _(spark, sf):
    """One own lag and one lagged regressor under every trend."""
    out, coef = None, lambda name: F.coalesce(F.get("coefs", F.array_position("terms", name).cast("int") - 1), F.lit(0.0))
    for trend in eco.TRENDS:
        one = _fixed_ardl(spark, sf, trend).select("series_id", F.lit(trend).alias("trend"), (coef("1") / 1000).alias("const"), coef("t").alias("slope"), coef("y1").alias("own"), coef("xa1").alias("other"))
        out = one if out is None else out.unionByName(one)
    return rounded(rounded(out, 4, "const", "slope"), 6, "own", "other")


@query("ardl_forecast_given", f"""WITH {_trends_sql()}, ends AS (SELECT series_id, max(n_rows) AS n, arg_max(close, row_idx) AS y0, arg_max(open, row_idx) AS x0 FROM panel GROUP BY 1),
  s1 AS (SELECT series_id, trend, n, const AS c, slope AS s, own AS a, other AS b, const + slope * (n + 1) + own * y0 + other * x0 AS f1 FROM ardl JOIN ends USING (series_id) WHERE trend IN ('c', 'ct')),
  s2 AS (SELECT *, c + s * (n + 2) + a * f1 + b * 51000 AS d2, c + s * (n + 2) + a * 70000 + b * 51000 AS t2 FROM s1),
  s3 AS (SELECT *, c + s * (n + 3) + a * d2 + b * 52000 AS d3, c + s * (n + 3) + a * t2 + b * 52000 AS t3 FROM s2),
  s4 AS (SELECT *, c + s * (n + 4) + a * d3 + b * 52000 AS d4, c + s * (n + 4) + a * t3 + b * 52000 AS t4 FROM s3)
  SELECT series_id, trend, mode, u.step::INTEGER AS step, round(u.f, 2) AS forecast FROM (SELECT series_id, trend, 'dynamic' AS mode, unnest([{{'step': 1, 'f': f1}}, {{'step': 2, 'f': d2}}, {{'step': 3, 'f': d3}}, {{'step': 4, 'f': d4}}]) AS u FROM s4
    UNION ALL SELECT series_id, trend, 'static', unnest([{{'step': 1, 'f': f1}}, {{'step': 2, 'f': t2}}, {{'step': 3, 'f': t3}}, {{'step': 4, 'f': t4}}]) FROM s4)""")
def _(spark, sf):
    """Given openings for two steps (the third keeps the last), and for static forecasts one close that came true."""
    out = None
    for trend in ("c", "ct"):
        fit = _fixed_ardl(spark, sf, trend)
        step = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(50_000.0 + 1000 * i).alias("open"), F.lit(70_000.0 if i == 1 else None).cast("double").alias("close")) for i in (1, 2)]))
        ahead = fit.select("series_id", step.alias("f")).select("series_id", "f.*")
        for mode, actual in (("dynamic", None), ("static", "close")):
            one = eco.ardl_forecast(fit, 4, 1, future=ahead, xs=["open"], actual=actual).select("series_id", F.lit(trend).alias("trend"), F.lit(mode).alias("mode"), "step", "forecast")
            out = one if out is None else out.unionByName(one)
    return rounded(out, 2)


_RES = f"""{RETURNS}, fit AS (SELECT series_id, regr_slope(close, prev) AS b, regr_intercept(close, prev) AS a FROM rets WHERE prev IS NOT NULL GROUP BY 1),
  res AS (SELECT r.series_id, close, close - a - b * prev AS e FROM rets r JOIN fit USING (series_id) WHERE prev IS NOT NULL),
  dg AS (SELECT series_id, count(*) AS n, sum(e * e) AS ssr, var_pop(close) * count(*) AS sst FROM res GROUP BY 1),
  dl AS (SELECT *, -n / 2.0::DOUBLE * (ln(2 * pi()) + ln(ssr / n) + 1) AS llf FROM dg)"""


@query("model_diagnostics", f"WITH {_RES} SELECT series_id, n, {rsql(4, llf='llf', aic='-2 * llf + 4', bic='-2 * llf + ln(n) * 2')}, round(1 - ssr / sst, 8) AS pseudo_r2 FROM dl")
def _(spark, sf):
    d = eco.model_diagnostics(eco.ar1_residuals(panel(spark, sf)), "residual", "close", 2)
    return rounded(rounded(d.select("series_id", "n", "llf", "aic", "bic", "pseudo_r2"), 4, "llf", "aic", "bic"), 8, "pseudo_r2")


@query("bounds_f_screen")
def _(spark, sf):
    return eco.bounds_f_screen(with_macro(spark, sf), "close", ["VIX"])


@query("bounds_guarded")
def _(spark, sf):
    return eco.bounds_guarded(panel(spark, sf), "close", ["open"]).withColumn("integration_orders", F.map_entries("integration_orders"))


_BOUND_CELLS = ("y1", "x1", "dx")
_BOUND_MAT = [f"covar_pop({a}, {b})" for a in _BOUND_CELLS for b in _BOUND_CELLS]
_BOUND_RIGHT = [f"covar_pop({a}, dy)" for a in _BOUND_CELLS]


@query("bounds_f_fixed", f"""WITH {PANEL}, l AS (SELECT * FROM (SELECT series_id, row_idx, close - lag(close) OVER ({W}) AS dy, lag(close) OVER ({W}) AS y1, lag(open) OVER ({W}) AS x1, open - lag(open) OVER ({W}) AS dx FROM panel) WHERE row_idx >= 2),
  b AS (SELECT series_id, count(*) AS n, var_pop(dy) AS yy, {', '.join(f'{_cramer(_BOUND_MAT, _BOUND_RIGHT, k)} AS b{k}' for k in range(3))}, {', '.join(f'{r} AS r{k}' for k, r in enumerate(_BOUND_RIGHT))}, covar_pop(dx, dy) * covar_pop(dx, dy) / var_pop(dx) AS short FROM l GROUP BY 1)
  SELECT series_id, round(((b0 * r0 + b1 * r1 + b2 * r2 - short) / 2) / ((yy - b0 * r0 - b1 * r1 - b2 * r2) / (n - 4)), 4) AS f_statistic, round(b0, 6) AS ec_speed, round(-b1 / b0, 6) AS long_run, n AS nobs FROM b""")
def _(spark, sf):
    """One own lag and one lag of the regressor: the F statistic from normal equations."""
    out = eco.bounds_f_screen(panel(spark, sf), "close", ["open"], fixed_order=(1, 1)).select("series_id", "f_statistic", "ec_speed", F.col("long_run")[0].alias("long_run"), "nobs")
    return rounded(rounded(out, 4, "f_statistic"), 6, "ec_speed", "long_run")


@query("cointegration_stage1", f"""WITH {BARS}, {PAIRS}, f AS (SELECT a, b, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM pr GROUP BY 1, 2)
  SELECT a, b, bar_date, round(slope, 8) AS slope, round(intercept, 4) AS intercept, round(y - intercept - slope * x, 4) AS residual FROM pr JOIN f USING (a, b)""")
def _(spark, sf):
    b = fx.bars_priority(spark, sf)
    out = eco.cointegration_residuals(joins.series_pairs(b, neighbour_pairs(b)))
    return rounded(rounded(out, 8, "slope"), 4, "intercept", "residual")


@query("cointegration_screen")
def _(spark, sf):
    b = fx.bars_priority(spark, sf)
    return eco.cointegration_screen(joins.series_pairs(b, neighbour_pairs(b)))


def fold_segments(df):
    """First fold whose training part (validation left out) holds the row, and the fold it is scored in."""
    f = folds.fold_array("n_rows")
    first = F.filter(f, lambda x: F.col("row_idx") < x["val_start"])
    test = F.filter(f, lambda x: (F.col("row_idx") >= x["test_start"]) & (F.col("row_idx") < x["test_end"] - 1))
    return df.withColumns({"segment": F.get(first, F.lit(0))["fold"], "fold": F.get(test, F.lit(0))["fold"]})


@query("arma_order_select")
def _(spark, sf):
    return eco.arma_order_select(fold_segments(returns(spark, sf)), "ret_1d", segment="segment", n_segments=5)


@query("rolling_arma_forecast")
def _(spark, sf):
    rows = fold_segments(returns(spark, sf))
    params = eco.arma_order_select(rows, "ret_1d", segment="segment", n_segments=5)
    return eco.rolling_arma_forecast(rows.select(*KEY, "row_idx", "ret_1d", "fold"), params)


@query("arma_css_fit")
def _(spark, sf):
    rows = fold_segments(returns(spark, sf))
    start = eco.arma_order_select(rows, "ret_1d", segment="segment", n_segments=5)
    return arma_css.css_fit(rows, "ret_1d", start, segment="segment")


def _css_sql(const: float, phi: float, theta: float) -> str:
    """Two passes from pinned ARMA(1, 1) parameters: sums at the start, one Gauss-Newton step by Cramer's rule, kept if it lowers the sum."""

    def run(n: str, of: str) -> str:
        """Residuals with the parameters c, f, t of each series, as weighted sums of what drives them."""
        return f"""u{n} AS (SELECT y.series_id, i, CASE WHEN i >= 1 THEN v - c - f * l ELSE 0 END AS u, CASE WHEN i >= 1 THEN 1 ELSE 0 END AS live, l, t FROM y JOIN {of} p USING (series_id)),
      e{n} AS (SELECT a.series_id, a.i, any_value(a.t) AS t, any_value(a.live) AS live, any_value(a.l) AS l, sum(pow(-a.t, a.i - b.i) * b.u) AS e FROM u{n} a JOIN u{n} b ON a.series_id = b.series_id AND b.i <= a.i GROUP BY 1, 2)"""

    jj, je = ["cc", "cf", "ct", "cf", "ff", "ft", "ct", "ft", "tt"], ["ce", "fe", "te"]
    step = lambda k: f"-{_cramer(jj, je, k)}"
    return f"""WITH {RETURNS}, r AS (SELECT series_id, ret_1d AS v, row_number() OVER ({W}) - 1 AS i FROM rets WHERE ret_1d IS NOT NULL),
      y AS (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY i) AS l FROM r),
      p0 AS (SELECT DISTINCT series_id, {const}::DOUBLE AS c, {phi}::DOUBLE AS f, {theta}::DOUBLE AS t FROM r), {run("0", "p0")},
      x0 AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY series_id ORDER BY i) AS el FROM e0),
      d0 AS (SELECT a.series_id, a.i, any_value(a.e) AS e, sum(-pow(-a.t, a.i - b.i) * b.live) AS dc, sum(-pow(-a.t, a.i - b.i) * b.live * coalesce(b.l, 0)) AS df, sum(-pow(-a.t, a.i - b.i) * b.el) AS dt
        FROM x0 a JOIN x0 b ON a.series_id = b.series_id AND b.i <= a.i GROUP BY 1, 2),
      s0 AS (SELECT series_id, sum(e * e) AS ss, sum(dc * dc) AS cc, sum(dc * df) AS cf, sum(dc * dt) AS ct, sum(df * df) AS ff, sum(df * dt) AS ft, sum(dt * dt) AS tt, sum(dc * e) AS ce, sum(df * e) AS fe, sum(dt * e) AS te FROM d0 GROUP BY 1),
      p1 AS (SELECT series_id, ss, {const} {step(0)} AS c, {phi} {step(1)} AS f, {theta} {step(2)} AS t FROM s0), {run("1", "p1")},
      s1 AS (SELECT series_id, sum(e * e) AS ss FROM e1 GROUP BY 1)
      SELECT series_id, round(c, 5) AS const, round(f, 5) AS phi, round(t, 5) AS theta, round(ln(p1.ss), 7) AS ln_start, round(ln(s1.ss), 7) AS ln_ss FROM p1 JOIN s1 USING (series_id)"""


@query("arma_css_steps", _css_sql(0.0, 0.1, 0.2))
def _(spark, sf):
    rows = returns(spark, sf)
    start = rows.select("series_id").distinct().select("series_id", F.lit(0.0).alias("const"), F.array(F.lit(0.1)).alias("phi"), F.array(F.lit(0.2)).alias("theta"))
    fit = arma_css.css_fit(rows, "ret_1d", start, rounds=2)
    out = fit.select("series_id", "const", F.col("phi")[0].alias("phi"), F.col("theta")[0].alias("theta"), F.ln("ss_start").alias("ln_start"), F.ln("ss").alias("ln_ss"))
    return rounded(rounded(out, 5, "const", "phi", "theta"), 7, "ln_start", "ln_ss")


@query("fixed_ar_forecast", f"""WITH {RETURNS}, f AS (SELECT series_id, bar_date, 0.001::DOUBLE + 0.3::DOUBLE * ret_1d - 0.1::DOUBLE * lag(ret_1d) OVER ({W}) AS forecast FROM rets)
  SELECT series_id, bar_date, round(forecast, 8) AS forecast FROM f""")
def _(spark, sf):
    df = windowed(returns(spark, sf), lambda d, w: d.withColumn("forecast", eco.fixed_ar_forecast(w, "ret_1d", 0.001, (0.3, -0.1))), back=1)
    return rounded(df.select(*KEY, "forecast"), 8)


@query("latest_arma_forecast")
def _(spark, sf):
    return eco.latest_arma_forecast(returns(spark, sf))


@query("persistence", f"WITH {BARS} SELECT series_id, bar_date, 0::DOUBLE AS forecast FROM bars")
def _(spark, sf):
    return fx.bars_priority(spark, sf).select(*KEY, blend.persistence().alias("forecast"))


@query("sign_persistence", f"""WITH {RETURNS}, s AS (SELECT series_id, sign(lag(ret_1d) OVER ({W})) AS f, sign(ret_1d) AS y FROM rets)
  SELECT series_id, count(f) AS n, round(avg(CAST(f = y AS DOUBLE)), 8) AS accuracy FROM s WHERE f IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    df = windowed(returns(spark, sf), lambda d, w: d.withColumn("f", blend.sign_persistence(w)), back=1).filter("f IS NOT NULL")
    return rounded(df.groupBy("series_id").agg(F.count("f").alias("n"), F.avg((F.col("f") == F.signum("ret_1d")).cast("double")).alias("accuracy")), 8)


