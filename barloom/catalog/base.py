"""Registry, shared inputs and shared SQL fragments of the query catalog."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import clip, ratio
from barloom.operators.features import pct_change, realised_vol, returns_target
from barloom.operators.folds import test_rows
from barloom.operators.joins import ffill_dates, outer_join_series
from barloom.operators.rolling import ar1_forecast
from barloom.plans.panel import row_index, windowed
from barloom.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MACRO = tuple(fx.MACRO_AGGREGATES)
W = "PARTITION BY series_id ORDER BY bar_date"
GRID = [NormalDist().inv_cdf((i + 0.5) / 30) for i in range(30)]


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round the named columns (default: every double column)."""
    cols = cols or tuple(n for n, t in df.dtypes if t == "double")
    return df.withColumns({c: F.round(c, digits) for c in cols})


def rsql(digits: int, **exprs: str) -> str:
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in exprs.items())


def over(expr: str, n: int | None = None, w: str = W) -> str:
    """`expr` over the series, optionally framed to the last n rows."""
    return f"{expr} OVER ({w}{f' ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW' if n else ''})"


def clip_sql(e: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({e}) IS NOT NULL THEN least(greatest({e}, {lo}::DOUBLE), {hi}::DOUBLE) END"


BARS = """bars AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS bar_date,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""
PANEL = BARS + f""", panel AS (
  SELECT *, row_number() OVER ({W}) - 1 AS row_idx, count(*) OVER (PARTITION BY series_id) AS n_rows FROM bars)"""
RETURNS = PANEL + f""", rets AS (
  SELECT *, close / lag(close) OVER ({W}) - 1 AS ret_1d, lag(close) OVER ({W}) AS prev,
         lead(close) OVER ({W}) AS nxt FROM panel)"""
MACRO_LONG = """macro AS (
  SELECT CAST(l_shipdate AS DATE) AS obs_date, avg(l_quantity) AS VIX, 100 * avg(l_discount) AS TNX,
         100 * avg(l_tax) AS IRX, sum(l_extendedprice) / 1000 AS DXY, max(l_extendedprice) / 100 AS GLD,
         min(l_extendedprice) / 10 AS TLT FROM lineitem GROUP BY 1)"""
FOLDS = """sizes AS (SELECT series_id, count(*) AS n FROM bars GROUP BY 1),
first_part AS (SELECT *, CAST(floor(n * 0.55::DOUBLE) AS BIGINT) AS initial FROM sizes),
steps AS (SELECT *, (n - initial) // 5 AS step FROM first_part),
folds AS (SELECT series_id, n, k + 1 AS fold, initial + step * k AS train_end,
  CAST(floor((initial + step * k) * (1 - 0.15::DOUBLE)) AS BIGINT) AS val_start,
  initial + step * k AS test_start, CASE WHEN k = 4 THEN n ELSE initial + step * (k + 1) END AS test_end
  FROM steps, (SELECT unnest(range(5)) AS k))"""
FORECASTS = RETURNS + ", " + FOLDS + f""", fc0 AS (
  SELECT r.series_id, r.bar_date, r.row_idx, r.close, r.ret_1d, f.fold, f.test_end,
    CASE WHEN nxt IS NULL THEN NULL WHEN close <= 0 THEN 0 ELSE {clip_sql('nxt / close - 1', -0.2, 0.2)} END AS actual,
    r.vol_21d, r.ar_forecast
  FROM (SELECT *,
      CASE WHEN count(ret_1d) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) = 21
           THEN stddev_samp(ret_1d) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) END AS vol_21d,
      CASE WHEN row_idx >= 119 THEN
        regr_intercept(close, prev) OVER ({W} ROWS BETWEEN 118 PRECEDING AND CURRENT ROW)
        + regr_slope(close, prev) OVER ({W} ROWS BETWEEN 118 PRECEDING AND CURRENT ROW) * close END AS ar_forecast
    FROM rets) r
  JOIN folds f ON r.series_id = f.series_id AND r.row_idx >= f.test_start AND r.row_idx < f.test_end - 1),
wide AS (SELECT *, 0::DOUBLE AS persistence, {clip_sql('ret_1d', -0.2, 0.2)} AS last_return,
    {clip_sql('(ar_forecast - close) / close', -0.2, 0.2)} AS ar1 FROM fc0 WHERE actual IS NOT NULL),
forecasts AS (
  SELECT series_id, bar_date, row_idx, fold, 'persistence' AS model, persistence AS pred, actual, vol_21d FROM wide
  UNION ALL SELECT series_id, bar_date, row_idx, fold, 'last_return', last_return, actual, vol_21d FROM wide
  UNION ALL SELECT series_id, bar_date, row_idx, fold, 'ar1', ar1, actual, vol_21d FROM wide)"""
SAMPLES = FORECASTS + f""", samples AS (
  SELECT w.series_id, w.fold, w.bar_date, z.i AS sample_id, w.ar1 + z.z * w.vol_21d AS value, w.actual
  FROM wide w, (SELECT unnest(range(30)) AS i, unnest([{', '.join(f'{z!r}::DOUBLE' for z in GRID)}]) AS z) z)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return row_index(fx.bars_priority(spark, sf), length="n_rows")


def macro_wide(spark: SparkSession, sf: str) -> DataFrame:
    return ffill_dates(outer_join_series(fx.macro_long(spark, sf), MACRO), MACRO)


def wide_forecasts(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    """Scored test rows of every fold with one column per model, the actual and the volatility."""
    df = row_index(fx.bars_priority(spark, sf) if bars is None else bars, length="n_rows")

    def build(d, w):
        d = d.withColumns({"ret_1d": pct_change("close", w), "_prev": F.lag("close").over(w)})
        return d.withColumns(
            {"actual": returns_target(w), "vol_21d": realised_vol("ret_1d", w, 21), "ar_forecast": ar1_forecast(w)}
        )

    rows = test_rows(windowed(df, build, back=121, ahead=1)).filter("actual IS NOT NULL")
    ar = ratio(F.col("ar_forecast") - F.col("close"), "close")
    return rows.select(
        "series_id", "bar_date", "row_idx", "close", "fold", "actual", "vol_21d",
        F.lit(0.0).alias("persistence"), clip("ret_1d", -0.2, 0.2).alias("last_return"), clip(ar, -0.2, 0.2).alias("ar1"),
    )


MODELS = ("persistence", "last_return", "ar1")


def forecasts(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    """Long form: series_id, bar_date, row_idx, fold, model, pred, actual, vol_21d."""
    wide = wide_forecasts(spark, sf, bars)
    return wide.unpivot(
        ["series_id", "bar_date", "row_idx", "fold", "actual", "vol_21d"], list(MODELS), "model", "pred"
    )


def sample_grid(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, actuals): 30 normal-quantile samples around the AR forecast per scored row."""
    wide = wide_forecasts(spark, sf, bars)
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(z).alias("z")) for i, z in enumerate(GRID)])
    rows = wide.select("series_id", "fold", "bar_date", "ar1", "vol_21d", F.explode(grid).alias("_g"))
    samples = rows.select(
        "series_id", "fold", "bar_date", F.col("_g.i").alias("sample_id"),
        (F.col("ar1") + F.col("_g.z") * F.col("vol_21d")).alias("value"),
    )
    return samples, wide.select("series_id", "fold", "bar_date", "actual")
