"""Forecast metrics, backtest statistics and stability checks as grouped aggregates.

All take a long forecast table with `pred` and `actual`; `by` is any set of grouping columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import equi, ratio
from barloom.plans.panel import CHUNK, IDX, MIN_CHUNK, windowed
from barloom.session import cut_lineage

PERIODS, RISK_FREE, COST_BPS = 252, 0.02, 10.0
ANNUAL = PERIODS**0.5


def _err() -> Column:
    return F.col("pred") - F.col("actual")


def _hit() -> Column:
    return (F.signum("pred") == F.signum("actual")).cast("double")


def _sharpe(mean: Column, dev: Column) -> Column:
    return F.when(dev > 1e-9, ANNUAL * mean / dev).otherwise(0.0)


def metric_columns() -> list[Column]:
    """MSE, RMSE, MAE, MAPE, direction, IC and the naive signal Sharpe as one aggregate list."""
    e, y, p = _err(), F.col("actual"), F.col("pred")
    flow = F.signum("pred") * y
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (100.0 * F.avg(F.abs(e / (F.abs(y) + 1e-8)))).alias("mape_pct"),
        F.avg(_hit()).alias("directional_accuracy"),
        # not F.corr: it raises on a constant side in ANSI mode
        F.when(
            (F.stddev_pop(p) > 1e-9) & (F.stddev_pop(y) > 1e-9),
            ratio(F.covar_pop(p, y), F.stddev_pop(p) * F.stddev_pop(y)),
        ).otherwise(0.0).alias("ic"),
        _sharpe(F.avg(flow), F.stddev_pop(flow)).alias("sharpe_naive"),
    ]


def forecast_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns())


def metric_report(df: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold") -> DataFrame:
    """Per-fold and pooled metrics in one pass (grouping sets); pooled rows have a NULL fold."""
    keys = [F.col(c) for c in (*by, fold)]
    return df.groupingSets([[*keys], [*keys[:-1]]], *keys).agg(*metric_columns())


def directional_accuracy_diff(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Agreement of the up / not-up moves of consecutive predictions and actuals, in percent."""

    def build(d: DataFrame, w) -> DataFrame:
        up = lambda c: (F.col(c) - F.lag(c).over(w)) > 0
        return d.withColumn("_agree", (up("pred") == up("actual")).cast("double"))

    return windowed(df, build, back=1, keys=keys).groupBy(*keys).agg(
        F.count("_agree").alias("n_moves"), (100.0 * F.avg("_agree")).alias("accuracy_pct")
    )


def strategy_returns(df: DataFrame, keys: Sequence[str], cost_bps: float = COST_BPS) -> DataFrame:
    """`strat`: sign(pred) * actual less the cost of each signal change (the first trade pays)."""

    def build(d: DataFrame, w) -> DataFrame:
        signal = F.signum("pred")
        changed = signal != F.lag(signal, 1, 0.0).over(w)
        return d.withColumn("strat", signal * F.col("actual") - changed.cast("double") * (cost_bps / 10_000.0))

    return windowed(df, build, back=1, keys=keys)


def drawdown_path(df: DataFrame, rets: Sequence[str], keys: Sequence[str], size: int = 4 * MIN_CHUNK) -> DataFrame:
    """keys, row_idx, the returns and, per return, equity_x, peak_x and drawdown_x.

    Equity and its running peak come from one two-level scan: a chunk's own product path and peak,
    scaled by the product of the chunks before and capped below by the peak reached there.
    """
    keys, first, here = list(keys), Window.unboundedPreceding, Window.currentRow
    local = Window.partitionBy(*keys, CHUNK).orderBy(IDX).rowsBetween(first, here)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(first, -1)
    slim = df.select(*keys, IDX, *rets, F.expr(f"{IDX} div {size}").alias(CHUNK))
    path = slim.withColumns({f"_p_{r}": F.product(1.0 + F.col(r)).over(local) for r in rets})
    path = path.withColumns({f"_m_{r}": F.max(f"_p_{r}").over(local) for r in rets})
    ends = path.groupBy(*keys, CHUNK).agg(
        *[F.max_by(f"_p_{r}", IDX).alias(f"_end_{r}") for r in rets], *[F.max(f"_p_{r}").alias(f"_top_{r}") for r in rets]
    )
    start = ends.withColumns({f"_s_{r}": F.coalesce(F.product(f"_end_{r}").over(before), F.lit(1.0)) for r in rets})
    start = start.withColumns({f"_k_{r}": F.max(F.col(f"_s_{r}") * F.col(f"_top_{r}")).over(before) for r in rets})
    carried = start.select(*keys, CHUNK, *[f"{x}{r}" for r in rets for x in ("_s_", "_k_")])
    out = equi(path, carried, [*keys, CHUNK])
    out = out.withColumns({f"equity_{r}": F.col(f"_s_{r}") * F.col(f"_p_{r}") for r in rets})
    out = out.withColumns({f"peak_{r}": F.greatest(f"_k_{r}", F.col(f"_s_{r}") * F.col(f"_m_{r}")) for r in rets})
    out = out.withColumns({f"drawdown_{r}": (F.col(f"equity_{r}") - F.col(f"peak_{r}")) / F.col(f"peak_{r}") for r in rets})
    return out.select(*keys, IDX, *rets, *[f"{x}_{r}" for r in rets for x in ("equity", "peak", "drawdown")])


def backtest(df: DataFrame, keys: Sequence[str], cost_bps: float = COST_BPS) -> DataFrame:
    """Sharpe, Sortino, drawdown, Calmar, win rate, profit factor and buy-and-hold per key.

    Sortino divides by the population deviation of the negative excess returns around their own mean;
    the equity peak starts at the first equity value.
    """
    daily = RISK_FREE / PERIODS
    flows = cut_lineage(strategy_returns(df, keys, cost_bps).select(*keys, IDX, "strat", "actual"))  # read by both scan levels
    path = drawdown_path(flows, ["strat", "actual"], keys)
    s, ex = F.col("strat"), F.col("strat") - daily
    down = F.when(ex < 0, ex)
    agg = path.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ex).alias("_ex"),
        F.stddev_pop(s).alias("_sd"),
        F.stddev_pop(down).alias("_dsd"),
        F.min("drawdown_strat").alias("max_drawdown"),
        F.max_by("equity_strat", IDX).alias("_last"),
        (100.0 * F.avg((s > 0).cast("double"))).alias("win_rate_pct"),
        F.coalesce(F.sum(F.when(s > 0, s)), F.lit(0.0)).alias("_gain"),
        F.abs(F.coalesce(F.sum(F.when(s < 0, s)), F.lit(0.0))).alias("_loss"),
        F.avg("actual").alias("_bh"),
        F.stddev_pop("actual").alias("_bh_sd"),
        F.min("drawdown_actual").alias("bh_max_drawdown"),
    )
    annual = F.pow("_last", F.lit(float(PERIODS)) / F.col("n")) - 1.0
    return agg.select(
        *keys,
        "n",
        _sharpe(F.col("_ex"), F.col("_sd")).alias("sharpe"),
        _sharpe(F.col("_ex"), F.col("_dsd")).alias("sortino"),
        "max_drawdown",
        annual.alias("annual_return"),
        F.when(F.abs("max_drawdown") > 1e-9, annual / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"),
        "win_rate_pct",
        F.when(F.col("_loss") > 1e-9, ratio("_gain", "_loss")).otherwise(float("inf")).alias("profit_factor"),
        (ANNUAL * (F.col("_bh") - daily) / (F.col("_bh_sd") + 1e-9)).alias("bh_sharpe"),
        "bh_max_drawdown",
    )


def gate_stats(df: DataFrame, alpha: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(alpha).alias("alpha_mean"),
        F.stddev_pop(alpha).alias("alpha_std"),
        F.min(alpha).alias("alpha_min"),
        F.max(alpha).alias("alpha_max"),
        (F.stddev_pop(alpha) > 1e-3).alias("is_active"),
        ((F.min(alpha) >= 0) & (F.max(alpha) <= 1)).alias("in_range"),
    )


def loss_terms(df: DataFrame, by: Sequence[str], alpha: str = "alpha", ar: str = "ar_return") -> DataFrame:
    """Correlation, squared-error, agreement and gate terms of the training objective, as metrics."""
    p, y = F.col("pred"), F.col("actual")
    # population covariance over sample deviations, with a floor in the denominator
    corr = F.covar_pop(p, y) / (F.stddev_samp(p) * F.stddev_samp(y) + 1e-8)
    terms = df.groupBy(*by).agg(
        (1.0 - corr).alias("ic_loss"),
        (5000.0 * F.avg((p - y) * (p - y))).alias("mse_loss"),
        (2500.0 * F.avg((p - F.col(ar)) * (p - F.col(ar)))).alias("agreement_loss"),
        F.exp(-100.0 * F.var_samp(alpha)).alias("gate_loss"),
    )
    return terms.withColumn("total_loss", F.expr("ic_loss + 0.5D * mse_loss + 0.1D * agreement_loss + 0.15D * gate_loss"))


def magnitude_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    cols = []
    for c in ("pred", "actual"):
        cols += [f(c).alias(f"{c}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(*cols).withColumn("variance_ok", F.col("pred_std") > 1e-3)


def rolling_stability(df: DataFrame, keys: Sequence[str], window: int = 30, limit: float = 15.0) -> DataFrame:
    """Accuracy of moves in tumbling windows of whole rows; stable when its deviation is below the limit."""

    def build(d: DataFrame, w) -> DataFrame:
        up = lambda c: (F.col(c) - F.lag(c).over(w)) > 0
        first = F.col(IDX) % window == 0
        return d.withColumn("_agree", F.when(~first, (up("pred") == up("actual")).cast("double")))

    moves = windowed(df, build, back=1, keys=keys).withColumn("_win", F.expr(f"{IDX} div {window}"))
    full = moves.groupBy(*keys, "_win").agg(F.count(F.lit(1)).alias("_n"), (100.0 * F.avg("_agree")).alias("_acc"))
    return full.filter(F.col("_n") == window).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg("_acc").alias("mean_accuracy"),
        F.stddev_pop("_acc").alias("std_accuracy"),
        F.min("_acc").alias("min_accuracy"),
        F.max("_acc").alias("max_accuracy"),
        (F.stddev_pop("_acc") < limit).alias("is_stable"),
    )


def consistency_check(first: DataFrame, second: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Largest deviation between two scorings of the same rows, and rows present on one side only."""
    a = first.select(*on, F.col("pred").alias("_p1"), F.lit(True).alias("_in1"))
    b = second.select(*on, F.col("pred").alias("_p2"), F.lit(True).alias("_in2"))
    both = a.join(b, list(on), "full")
    spread = F.abs(F.col("_p1") - F.col("_p2")) / 2.0
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_in1").isNull() | F.col("_in2").isNull()).alias("unmatched"),
        F.coalesce(F.max(spread), F.lit(0.0)).alias("max_std"),
        (F.coalesce(F.max(spread), F.lit(0.0)) < 1e-6).alias("consistent"),
    )


def noise_sensitivity(
    df: DataFrame, inputs: Sequence[str], score, by: Sequence[str], levels: Sequence[float] = (0.01, 0.05, 0.10),
    draws: int = 10, seed: int = 42,
) -> DataFrame:
    """Mean absolute forecast change under Gaussian input noise; `score` maps input columns to a forecast.

    Levels and draws are a fixed grid exploded per row, so no row is ever joined to another.
    """
    base = df.withColumn("_base", score({c: F.col(c) for c in inputs}))
    grid = base.withColumn("noise_level", F.explode(F.array(*[F.lit(float(v)) for v in levels]))).withColumn(
        "draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))
    )
    noisy = {c: F.col(c) + F.col("noise_level") * F.randn(seed + i) for i, c in enumerate(inputs)}
    moved = F.abs(score(noisy) - F.col("_base"))
    return grid.withColumn("_moved", moved).groupBy(*by, "noise_level").agg(
        F.count("_moved").alias("n"), F.avg("_moved").alias("mean_abs_change")
    )


def period_summary(df: DataFrame, by: Sequence[str], period: str = "period") -> DataFrame:
    """RMSE, MAE and direction per period."""
    e = _err()
    return df.groupBy(*by, period).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (100.0 * F.avg(_hit())).alias("directional_accuracy"),
    )


def across_periods(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    return summary.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.avg("directional_accuracy").alias("mean_accuracy"),
        F.stddev_pop("directional_accuracy").alias("std_accuracy"),
        F.avg("rmse").alias("mean_rmse"),
    )


def confusion_matrix(df: DataFrame, by: Sequence[str]) -> DataFrame:
    up_p, up_y = F.col("pred") > 0, F.col("actual") > 0
    return df.groupBy(*by).agg(
        F.count_if(up_p & up_y).alias("tp"),
        F.count_if(up_p & ~up_y).alias("fp"),
        F.count_if(~up_p & up_y).alias("fn"),
        F.count_if(~up_p & ~up_y).alias("tn"),
    )


def coverage_of(lower: str, upper: str) -> Column:
    return F.avg(F.col("actual").between(F.col(lower), F.col(upper)).cast("double"))


