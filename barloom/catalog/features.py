"""Window and recursive features of the daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, MACRO, MACRO_LONG, PANEL, RETURNS, W, clip_sql, macro_wide, over, panel, query, rounded, rsql
from barloom.operators import clean, features as ft, joins, recursive
from barloom.plans.panel import windowed
from barloom.sources import fixtures as fx

KEY = ("series_id", "bar_date")


def window_query(name: str, cols, sql_cols: str, back: int, digits: int = 6, ahead: int = 0, source: str = PANEL, table: str = "panel"):
    """Register a query that adds `cols(window)` (a dict) to the panel."""

    def run(spark, sf):
        names = []

        def build(d, w):
            if table == "rets":
                d = d.withColumn("ret_1d", ft.pct_change("close", w))
            new = cols(w)
            names.extend(new)
            return d.withColumns(new)

        return rounded(windowed(panel(spark, sf), build, back=back, ahead=ahead).select(*KEY, *names), digits)

    query(name, f"WITH {source} SELECT series_id, bar_date, {sql_cols} FROM {table}")(run)


window_query("sma", lambda w: {"sma_20": ft.sma("close", w, 20)}, rsql(6, sma_20=over("avg(close)", 20)), 19)


def _bands(w):
    u, m, lo = ft.bollinger("close", w)
    return {"bb_upper": u, "bb_middle": m, "bb_lower": lo, "bb_width": ft.bollinger_width("close", w)}


_A, _S = over("avg(close)", 20), over("stddev_samp(close)", 20)
window_query(
    "bollinger", _bands,
    rsql(6, bb_upper=f"{_A} + 2 * {_S}", bb_middle=_A, bb_lower=f"{_A} - 2 * {_S}", bb_width=f"4 * {_S} / ({_A} + 1e-10)"),
    19, 6,
)
_L = lambda n, c="close": over(f"lag({c}, {n})")
window_query("momentum", lambda w: {"mom": ft.momentum("close", w)}, rsql(6, mom=f"close - {_L(10)}"), 10)
window_query("rate_of_change", lambda w: {"roc": ft.rate_of_change("close", w)}, rsql(6, roc=f"100 * (close / {_L(10)} - 1)"), 10)
window_query(
    "returns", lambda w: {f"ret_{n}d": ft.pct_change("close", w, n) for n in (1, 5, 10, 21)},
    rsql(8, **{f"ret_{n}d": f"close / {_L(n)} - 1" for n in (1, 5, 10, 21)}), 21, 8,
)
_full = lambda n: f"CASE WHEN {over('count(ret_1d)', n)} = {n} THEN {over('stddev_samp(ret_1d)', n)} END"
window_query(
    "realised_volatility", lambda w: {f"vol_{n}d": ft.realised_vol("ret_1d", w, n) for n in (5, 10, 21)},
    rsql(8, **{f"vol_{n}d": _full(n) for n in (5, 10, 21)}), 22, 8, source=RETURNS, table="rets",
)
_smar = lambda n: clip_sql(f"close / CASE WHEN {over('count(close)', n)} = {n} THEN {over('avg(close)', n)} END - 1", -0.5, 0.5)
window_query(
    "sma_ratios", lambda w: {f"sma{n}_ratio": ft.sma_ratio("close", w, n) for n in (10, 20, 50, 200)},
    rsql(8, **{f"sma{n}_ratio": _smar(n) for n in (10, 20, 50, 200)}), 199, 8,
)
window_query("overnight_gap", lambda w: {"overnight_gap": ft.overnight_gap(w)}, rsql(8, overnight_gap=clip_sql(f"open / {_L(1)} - 1", -0.1, 0.1)), 1, 8)
window_query("intraday_range", lambda w: {"intraday_range": ft.intraday_range()}, rsql(8, intraday_range=clip_sql("(high - low) / close", 0, 0.2)), 0, 8)
window_query("close_position", lambda w: {"close_position": ft.close_position()}, rsql(8, close_position="coalesce(CASE WHEN high <> low THEN (close - low) / (high - low) END, 0.5)"), 0, 8)
_vr = f"volume / CASE WHEN {over('count(volume)', 20)} = 20 THEN {over('avg(volume)', 20)} END"
window_query("volume_ratio", lambda w: {"volume_ratio": ft.volume_ratio(w)}, rsql(8, volume_ratio=clip_sql(_vr, 0, 10)), 19, 8)
_end = "bar_date = last_day(bar_date)"
window_query(
    "calendar_features", lambda w: ft.calendar(),
    rsql(8, dow="(isodow(bar_date) - 1) / 4.0", month_frac="(month(bar_date) - 1) / 11.0",
         is_month_end=f"CAST({_end} AS DOUBLE)", is_quarter_end=f"CAST({_end} AND month(bar_date) % 3 = 0 AS DOUBLE)"), 0, 8,
)
_tgt = lambda h: f"{over(f'lead(close, {h})')} / close - 1"
window_query(
    "returns_target",
    lambda w: {"target_1": ft.returns_target(w), "target_5": ft.returns_target(w, 5), "raw_5": ft.returns_target(w, 5, clipped=False)},
    rsql(8, target_1=clip_sql(_tgt(1), -0.2, 0.2), target_5=clip_sql(_tgt(5), -0.2, 0.2), raw_5=_tgt(5)), 0, 8, ahead=5,
)


@query("on_balance_volume", f"""WITH {RETURNS} SELECT series_id, bar_date,
  sum(CASE WHEN prev IS NULL THEN volume ELSE sign(close - prev) * volume END) OVER ({W}) AS obv FROM rets""")
def _(spark, sf):
    return ft.on_balance_volume(panel(spark, sf)).select(*KEY, F.col("OBV").alias("obv"))


@query("difference", f"""WITH {PANEL}, d1 AS (SELECT *, close - lag(close) OVER ({W}) AS diff_1 FROM panel),
  d2 AS (SELECT *, diff_1 - lag(diff_1) OVER ({W}) AS diff_2 FROM d1)
  SELECT series_id, bar_date, round(diff_1, 4) AS diff_1, round(diff_2, 4) AS diff_2 FROM d2 WHERE diff_2 IS NOT NULL""")
def _(spark, sf):
    df = windowed(
        panel(spark, sf), lambda d, w: d.withColumns({"diff_1": ft.difference("close", w), "diff_2": ft.difference("close", w, 2)}), back=2
    )
    return rounded(df.filter("diff_2 IS NOT NULL").select(*KEY, "diff_1", "diff_2"), 4)


@query("inverse_difference", f"WITH {PANEL} SELECT series_id, bar_date, round(close, 4) AS level FROM panel")
def _(spark, sf):
    df = panel(spark, sf)
    diffs = windowed(df, lambda d, w: d.withColumn("diff", F.coalesce(ft.difference("close", w), F.lit(0.0))), back=1)
    origin = df.groupBy("series_id").agg(F.min_by("close", "row_idx").alias("origin"))
    out = ft.inverse_difference(diffs.join(origin, "series_id"), "diff", "origin")
    return rounded(out.select(*KEY, "level"), 4)


@query("inverse_difference_order2", f"WITH {PANEL} SELECT series_id, bar_date, round(close, 3) AS level FROM panel WHERE row_idx >= 1")
def _(spark, sf):
    df = panel(spark, sf)
    d2 = windowed(df, lambda d, w: d.withColumn("diff", ft.difference("close", w, 2)), back=2).filter("row_idx >= 1")
    d2 = d2.withColumns({"diff": F.coalesce("diff", F.lit(0.0)), "row_idx": F.col("row_idx") - 1})
    start = df.groupBy("series_id").agg(F.min_by("close", "row_idx").alias("c0"), F.min_by("open", "row_idx").alias("_o"))
    one = df.filter("row_idx = 1").select("series_id", F.col("close").alias("c1"))
    base = d2.join(start, "series_id").join(one, "series_id").withColumn("slope", F.col("c1") - F.col("c0"))
    out = ft.inverse_difference(base, "diff", "c0", "level", slope="slope")
    return rounded(out.select(*KEY, "level"), 3)


@query("target_alignment_check", f"""WITH {RETURNS} SELECT series_id, count(*) AS n, 0::BIGINT AS mismatches
  FROM rets WHERE nxt IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    """Target from lead() against the next row's backward return, joined on the row position."""
    df = windowed(panel(spark, sf), lambda d, w: d.withColumns({"target": ft.returns_target(w), "ret_1d": ft.pct_change("close", w)}), back=1, ahead=1)
    back = df.select("series_id", (F.col("row_idx") - 1).alias("row_idx"), F.least(F.greatest("ret_1d", F.lit(-0.2)), F.lit(0.2)).alias("rebuilt"))
    both = df.join(back, ["series_id", "row_idx"])
    return both.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("target") - F.col("rebuilt")) > 1e-10).alias("mismatches")
    )


# --- macro features on the as-of aligned table
_M = f"""{BARS}, {MACRO_LONG}, al AS (SELECT b.*, m.* EXCLUDE (obs_date) FROM bars b ASOF LEFT JOIN macro m ON b.bar_date >= m.obs_date)"""


def _macro_query(name: str, cols: tuple[str, ...], sql_cols: str, digits: int = 6):
    def run(spark, sf):
        df = joins.align_macro(panel(spark, sf), macro_wide(spark, sf))
        out = windowed(df, lambda d, w: ft.macro_features(d, w, MACRO), back=1)
        return rounded(out.select(*KEY, *cols), digits)

    query(name, f"WITH {_M} SELECT series_id, bar_date, {sql_cols} FROM al")(run)


_ch = lambda c: f"CASE WHEN {_L(1, c)} <> 0 THEN {c} / {_L(1, c)} END - 1"
_macro_query("macro_vix", ("vix", "vix_change"), rsql(6, vix="VIX", vix_change=clip_sql(_ch("VIX"), -1, 1)))
_macro_query(
    "macro_yields", ("yield_10y", "yield_3m", "yield_change", "yield_spread"),
    rsql(6, yield_10y="TNX", yield_3m="IRX", yield_change=clip_sql(f"TNX - {_L(1, 'TNX')}", -2, 2), yield_spread=clip_sql("TNX - IRX", -5, 5)),
)
_macro_query("macro_dollar", ("dxy", "dxy_change"), rsql(6, dxy="DXY", dxy_change=clip_sql(_ch("DXY"), -0.1, 0.1)))
_macro_query("macro_gold_bonds", ("gold_ret", "tlt_ret"), rsql(6, gold_ret=clip_sql(_ch("GLD"), -0.1, 0.1), tlt_ret=clip_sql(_ch("TLT"), -0.1, 0.1)))


# --- recursive indicators
def ema_cte(name: str, source: str, x: str, alpha: str, out: str) -> str:
    """Recursive CTE of y = alpha * x + (1 - alpha) * y_prev with y_0 = x_0 (name holds series_id, row_idx, out)."""
    return f"""{name} AS (
  SELECT series_id, row_idx, {x} AS {out} FROM {source} WHERE row_idx = 0
  UNION ALL
  SELECT s.series_id, s.row_idx, {alpha} * s.{x} + (1 - {alpha}) * p.{out}
  FROM {name} p JOIN {source} s ON s.series_id = p.series_id AND s.row_idx = p.row_idx + 1)"""


def _alpha(span: int) -> str:
    return f"(2.0::DOUBLE / {span + 1})"


_POS = PANEL.replace("bars AS (", "bars AS MATERIALIZED (", 1).replace("panel AS (", "panel AS MATERIALIZED (", 1)


@query("ema", f"""WITH RECURSIVE {_POS}, {ema_cte('e', 'panel', 'close', _alpha(12), 'y')}
  SELECT p.series_id, p.bar_date, round(e.y, 4) AS ema_12 FROM e JOIN panel p USING (series_id, row_idx)""")
def _(spark, sf):
    return rounded(recursive.ema(panel(spark, sf), "close", 12, "ema_12").select(*KEY, "ema_12"), 4)


MACD_CTES = f"""{ema_cte('ef', 'panel', 'close', _alpha(12), 'y')}, {ema_cte('es', 'panel', 'close', _alpha(26), 'y')},
  md AS MATERIALIZED (SELECT series_id, row_idx, ef.y - es.y AS macd FROM ef JOIN es USING (series_id, row_idx)),
  {ema_cte('sg', 'md', 'macd', _alpha(9), 'y')}"""


def _indicators(spark, sf, which):
    return recursive.add_indicators(panel(spark, sf), which=which).select(*KEY, *[F.col(c).alias(c.lower()) for c in which])


@query("macd", f"""WITH RECURSIVE {_POS}, {MACD_CTES}
  SELECT p.series_id, p.bar_date, round(md.macd, 4) AS macd, round(sg.y, 4) AS macd_signal, round(md.macd - sg.y, 4) AS macd_hist
  FROM md JOIN sg USING (series_id, row_idx) JOIN panel p USING (series_id, row_idx)""")
def _(spark, sf):
    return rounded(_indicators(spark, sf, ("MACD", "MACD_Signal", "MACD_Hist")), 4)


MOVES = f"""mv AS MATERIALIZED (SELECT series_id, row_idx,
    greatest(high - low, abs(high - coalesce(lag(close) OVER ({W}), close)), abs(low - coalesce(lag(close) OVER ({W}), close))) AS tr,
    CASE WHEN high - lag(high) OVER ({W}) > lag(low) OVER ({W}) - low AND high - lag(high) OVER ({W}) > 0 THEN high - lag(high) OVER ({W}) ELSE 0 END AS pdm,
    CASE WHEN lag(low) OVER ({W}) - low > high - lag(high) OVER ({W}) AND lag(low) OVER ({W}) - low > 0 THEN lag(low) OVER ({W}) - low ELSE 0 END AS mdm,
    greatest(close - lag(close) OVER ({W}), 0) AS gain, greatest(lag(close) OVER ({W}) - close, 0) AS loss FROM panel)"""
ATR_CTE = ema_cte("atr", "mv", "tr", _alpha(14), "y")
ADX_CTES = f"""{ema_cte('pdi', 'mv', 'pdm', _alpha(14), 'y')}, {ema_cte('mdi', 'mv', 'mdm', _alpha(14), 'y')},
  dx AS MATERIALIZED (SELECT series_id, row_idx, 100 * abs(pdi.y - mdi.y) / (pdi.y + mdi.y + 1e-10) AS dx FROM pdi JOIN mdi USING (series_id, row_idx)),
  {ema_cte('adx', 'dx', 'dx', _alpha(14), 'y')}"""
RSI_CTES = """seed AS (SELECT series_id, sum(gain) / 14 AS u0, sum(loss) / 14 AS d0 FROM mv WHERE row_idx BETWEEN 1 AND 15 GROUP BY 1),
  wl AS (SELECT m.series_id, m.row_idx, s.u0 AS u, s.d0 AS d FROM mv m JOIN seed s USING (series_id) WHERE m.row_idx = 13
    UNION ALL
    SELECT m.series_id, m.row_idx, (p.u * 13 + m.gain) / 14, (p.d * 13 + m.loss) / 14 FROM wl p JOIN mv m ON m.series_id = p.series_id AND m.row_idx = p.row_idx + 1),
  rsi AS (SELECT series_id, row_idx, 100 - 100 / (1 + CASE WHEN d <> 0 THEN u / d ELSE 0 END) AS y FROM
    (SELECT series_id, row_idx, u, d FROM wl UNION ALL SELECT m.series_id, m.row_idx, s.u0, s.d0 FROM mv m JOIN seed s USING (series_id) WHERE m.row_idx < 13))"""


@query("atr", f"""WITH RECURSIVE {_POS}, {MOVES}, {ATR_CTE}
  SELECT p.series_id, p.bar_date, round(atr.y, 4) AS atr FROM atr JOIN panel p USING (series_id, row_idx)""")
def _(spark, sf):
    return rounded(_indicators(spark, sf, ("ATR",)), 4)


@query("adx", f"""WITH RECURSIVE {_POS}, {MOVES}, {ADX_CTES}
  SELECT p.series_id, p.bar_date, round(adx.y, 6) AS adx FROM adx JOIN panel p USING (series_id, row_idx)""")
def _(spark, sf):
    return rounded(_indicators(spark, sf, ("ADX",)), 6)


@query("rsi", f"""WITH RECURSIVE {_POS}, {MOVES}, {RSI_CTES}
  SELECT p.series_id, p.bar_date, round(rsi.y, 6) AS rsi FROM rsi JOIN panel p USING (series_id, row_idx)""")
def _(spark, sf):
    return rounded(_indicators(spark, sf, ("RSI",)), 6)


@query("technical_indicators", f"""WITH RECURSIVE {_POS}, {MOVES}, {ATR_CTE}, {ADX_CTES}, {RSI_CTES}, {MACD_CTES}
  SELECT p.series_id, p.bar_date, round(rsi.y, 6) AS "RSI", round(md.macd, 4) AS "MACD", round(sg.y, 4) AS "MACD_Signal",
    round(md.macd - sg.y, 4) AS "MACD_Hist", round(atr.y, 4) AS "ATR", round(adx.y, 6) AS "ADX",
    round(p.bb_up, 4) AS "BB_Upper", round(p.bb_mid, 4) AS "BB_Middle", round(p.bb_lo, 4) AS "BB_Lower", round((p.bb_up - p.bb_lo) / (p.bb_mid + 1e-10), 4) AS "BB_Width",
    round(p.mom, 4) AS "MOM", round(p.roc, 4) AS "ROC", p.obv AS "OBV"
  FROM (SELECT *, {_A} + 2 * {_S} AS bb_up, {_A} AS bb_mid, {_A} - 2 * {_S} AS bb_lo, close - {_L(10)} AS mom, 100 * (close / {_L(10)} - 1) AS roc,
        sum(f) OVER ({W}) AS obv FROM (SELECT *, CASE WHEN {_L(1)} IS NULL THEN volume ELSE sign(close - {_L(1)}) * volume END AS f FROM panel)) p
  JOIN rsi USING (series_id, row_idx) JOIN md USING (series_id, row_idx) JOIN sg USING (series_id, row_idx)
  JOIN atr USING (series_id, row_idx) JOIN adx USING (series_id, row_idx)""")
def _(spark, sf):
    df = ft.technical_indicators(panel(spark, sf))
    six = ("RSI", "ADX")
    return df.select(*KEY, *[F.round(c, 6 if c in six else 4).alias(c) for c in ft.INDICATOR_COLUMNS if c != "OBV"], "OBV")


_NATIVE = {
    "BB_Width": f"4 * {_S} / ({_A} + 1e-10)", "MOM": f"close - {_L(10)}", "ROC": f"100 * (close / {_L(10)} - 1)",
    **{f"ret_{n}d": f"close / {_L(n)} - 1" for n in (1, 5, 10, 21)},
    **{f"vol_{n}d": _full(n) for n in (5, 10, 21)}, **{f"sma{n}_ratio": _smar(n) for n in (10, 20, 50, 200)},
    "overnight_gap": clip_sql(f"open / {_L(1)} - 1", -0.1, 0.1), "intraday_range": clip_sql("(high - low) / close", 0, 0.2),
    "close_position": "coalesce(CASE WHEN high <> low THEN (close - low) / (high - low) END, 0.5)", "volume_ratio": clip_sql(_vr, 0, 10),
    "dow": "(isodow(bar_date) - 1) / 4.0", "month_frac": "(month(bar_date) - 1) / 11.0",
    "is_month_end": f"CAST({_end} AS DOUBLE)", "is_quarter_end": f"CAST({_end} AND month(bar_date) % 3 = 0 AS DOUBLE)",
    "vix": "VIX", "vix_change": clip_sql(_ch("VIX"), -1, 1), "yield_10y": "TNX", "yield_3m": "IRX",
    "yield_change": clip_sql(f"TNX - {_L(1, 'TNX')}", -2, 2), "yield_spread": clip_sql("TNX - IRX", -5, 5),
    "dxy": "DXY", "dxy_change": clip_sql(_ch("DXY"), -0.1, 0.1), "gold_ret": clip_sql(_ch("GLD"), -0.1, 0.1), "tlt_ret": clip_sql(_ch("TLT"), -0.1, 0.1),
}
_REC = {"RSI": "rsi.y", "MACD": "md.macd", "MACD_Signal": "sg.y", "MACD_Hist": "md.macd - sg.y", "ATR": "atr.y", "ADX": "adx.y"}
FEATURE_CTES = f"""{_POS}, {MACRO_LONG}, {MOVES}, {ATR_CTE}, {ADX_CTES}, {RSI_CTES}, {MACD_CTES},
  al AS (SELECT b.*, m.* EXCLUDE (obs_date) FROM (SELECT *, close / {_L(1)} - 1 AS ret_1d_ FROM panel) b ASOF LEFT JOIN macro m ON b.bar_date >= m.obs_date),
  nat AS (SELECT series_id, bar_date, row_idx, n_rows, close, {', '.join(f'{e} AS "{n}"' for n, e in _NATIVE.items()).replace('ret_1d)', 'ret_1d_)')},
    CASE WHEN {_L(1)} IS NULL THEN volume ELSE sign(close - {_L(1)}) * volume END AS flow FROM al),
  feats AS (SELECT nat.* EXCLUDE (flow), sum(flow) OVER (PARTITION BY nat.series_id ORDER BY bar_date) AS "OBV",
    {', '.join(f'{e} AS "{n}"' for n, e in _REC.items())}
    FROM nat JOIN rsi USING (series_id, row_idx) JOIN md USING (series_id, row_idx) JOIN sg USING (series_id, row_idx)
    JOIN atr USING (series_id, row_idx) JOIN adx USING (series_id, row_idx))"""
_DIG = {"MACD": 4, "MACD_Signal": 4, "MACD_Hist": 4, "ATR": 4, "BB_Width": 5, "MOM": 4, "ROC": 5, "OBV": 1}


def feature_select(wrap=lambda c: f'"{c}"') -> str:
    return ", ".join(f'round({wrap(c)}, {_DIG.get(c, 6)}) AS "{c}"' for c in ft.FEATURES)


def round_features(df, *keep):
    return df.select(*keep, *[F.round(c, _DIG.get(c, 6)).alias(c) for c in ft.FEATURES])


@query("engineer_features", f"WITH RECURSIVE {FEATURE_CTES} SELECT series_id, bar_date, close, {feature_select()} FROM feats")
def _(spark, sf):
    df = ft.engineer_features(fx.bars_priority(spark, sf), macro_wide(spark, sf))
    return round_features(df, *KEY, "close")


def _bfilled(c: str) -> str:
    return f"""coalesce(last_value("{c}" IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value("{c}" IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY bar_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)"""


@query("engineer_features_filled", f"WITH RECURSIVE {FEATURE_CTES} SELECT series_id, bar_date, close, {feature_select(_bfilled)} FROM feats")
def _(spark, sf):
    df = ft.engineer_features(fx.bars_priority(spark, sf), macro_wide(spark, sf), warmup="bfill")
    return round_features(df, *KEY, "close")


@query("drop_raw_columns", f"WITH {BARS} SELECT series_id, bar_date, close FROM bars")
def _(spark, sf):
    return clean.drop_raw_columns(fx.bars_priority(spark, sf))
