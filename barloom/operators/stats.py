"""Significance tests: aggregates in Spark, tail probabilities on the aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.special import binomial_p, student_p
from barloom.plans.panel import windowed


def direction_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    hit = F.signum("pred") == F.signum("actual")
    return df.groupBy(*by).agg(F.count_if(hit).alias("n_correct"), F.count(F.lit(1)).alias("n"))


def binomial_test(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact test of the direction hits against one half, with the exact 95% interval."""
    counts = direction_counts(df, by)
    return counts.withColumn("_b", binomial_p("n_correct", "n")).select(*counts.columns, "_b.*")


def dm_statistic(
    df: DataFrame, first: str, second: str, keys: Sequence[str], h: int = 1, loss: str = "squared"
) -> DataFrame:
    """Loss-differential statistic with the small-sample factor, per key.

    Needs `row_idx` per key when h > 1: the lagged products are windows of h - 1 rows. The variance is
    the population variance plus Bartlett-weighted sample autocovariances, floored at 1e-300.
    """
    size = {"squared": lambda e: e * e, "absolute": F.abs}[loss]
    l1, l2 = (size(F.col("actual") - F.col(c)) for c in (first, second))
    work = df.withColumns({"_l1": l1, "_l2": l2, "_d": l1 - l2})
    if h > 1:
        work = windowed(
            work, lambda d, w: d.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, h)}), back=h - 1, keys=keys
        )
    agg = work.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_d").alias("_mean"),
        F.var_pop("_d").alias("_g0"),
        F.avg("_l1").alias("mean_loss_model1"),
        F.avg("_l2").alias("mean_loss_model2"),
        *[F.covar_samp("_d", f"_d{k}").alias(f"_g{k}") for k in range(1, h)],
    )
    var = F.col("_g0")
    for k in range(1, h):
        var = var + F.lit(2.0 * (1.0 - k / h)) * F.col(f"_g{k}")
    n = F.col("n")
    factor = F.sqrt((n + 1 - 2 * h + F.lit(float(h * (h - 1))) / n) / n)
    return agg.select(
        *keys,
        "n",
        (F.col("_mean") / F.sqrt(F.greatest(var, F.lit(1e-300)) / n) * factor).alias("dm_statistic"),
        "mean_loss_model1",
        "mean_loss_model2",
    )


def diebold_mariano(
    df: DataFrame, first: str, second: str, keys: Sequence[str], h: int = 1, loss: str = "squared", level: float = 0.05
) -> DataFrame:
    stat = dm_statistic(df, first, second, keys, h, loss).withColumn("p_value", student_p("dm_statistic", F.col("n") - 1))
    sure = F.col("p_value") < level
    # fixed values: callers match these sentences
    verdict = (
        F.when(sure & (F.col("dm_statistic") < 0), "model1 significantly more accurate")
        .when(sure & (F.col("dm_statistic") > 0), "model2 significantly more accurate")
        .otherwise("no significant difference in forecast accuracy")
    )
    return stat.withColumns(
        {"loss_function": F.lit(loss), "horizon": F.lit(h), "interpretation": verdict}
    )
