"""Alignment joins of panels and macro series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import equi
from barloom.plans.attach import attach
from barloom.plans.panel import KEYS, running


def outer_join_series(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per date over all names, one column per name."""
    return long.groupBy("obs_date").pivot("name", list(names)).agg(F.first("value", ignorenulls=True))


def _calendar_window(order: str):
    """Order of a table with one row per calendar day: its size is bounded by the days it spans."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def ffill_dates(wide: DataFrame, cols: Sequence[str], order: str = "obs_date") -> DataFrame:
    """Forward fill a table with one row per date."""
    if not isinstance(wide.schema[order].dataType, T.DateType):
        keyed = wide.withColumn("_all", F.lit(0))
        return running(keyed, {c: ("last", F.col(c)) for c in cols}, ["_all"], [order]).select(order, *cols)
    w = _calendar_window(order).rowsBetween(Window.unboundedPreceding, 0)
    return wide.select(order, *[F.last(c, True).over(w).alias(c) for c in cols])


def asof_align(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    left_on: str = "bar_date",
    right_on: str = "obs_date",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Backward as-of join: each left row takes the latest right row at or before it, per key.

    Both sides are merged on one time line and the last right row is carried forward, so there is
    no range join and a long series is split over tasks.
    """
    keys, extra = list(keys), [c for c in left.columns if c not in (*keys, left_on)]
    # a right row is carried as one struct: a NULL inside it must not fall back to an older row
    lhs = left.select(*keys, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*extra).alias("_row"))
    rhs = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.struct(*cols).alias("_hit"))
    line = lhs.unionByName(rhs, allowMissingColumns=True)
    carried = running(line, {"_hit": ("last", F.col("_hit"))}, keys, ["_t", "_side"])
    return carried.filter("_side = 1").select(
        *keys, F.col("_t").alias(left_on), *[F.col(f"_row.{c}") for c in extra], *[F.col(f"_hit.{c}") for c in cols]
    )


def align_macro(df: DataFrame, macro: DataFrame, on: str = "bar_date") -> DataFrame:
    """As-of join of one wide macro table onto every series.

    The macro side is spread over calendar days (each row is valid until the next one), which turns
    the as-of join into an equi-join on the date. One row per day is measured and broadcast, so the panel, which has few and
    uneven days, isn't shuffled by them. Values must already be forward filled.
    """
    cols = [c for c in macro.columns if c != "obs_date"]
    horizon = df.agg(F.max(on).alias("_horizon")).withColumn("_all", F.lit(0))  # one row
    spans = (
        macro.select("obs_date", *cols, F.lead("obs_date").over(_calendar_window("obs_date")).alias("_next"), F.lit(0).alias("_all"))
        .join(F.broadcast(horizon), "_all")
        .withColumn("_last", F.coalesce(F.date_sub("_next", 1), F.greatest("obs_date", "_horizon")))
    )
    daily = spans.select(F.explode(F.sequence("obs_date", "_last")).alias(on), *cols)
    return attach(df, daily, [on], "left")


def series_pairs(
    bars: DataFrame, pairs: DataFrame, value: str = "close", key: str = "series_id", order: str = "bar_date"
) -> DataFrame:
    """Rows of two series on their common dates, for each requested pair (a, b)."""
    slim = bars.select(key, order, value)
    left = pairs.select("a", "b").join(slim.withColumnRenamed(key, "a").withColumnRenamed(value, "y"), "a")
    right = slim.withColumnRenamed(key, "b").withColumnRenamed(value, "x")
    return left.join(right, ["b", order]).select("a", "b", order, "y", "x")


def align_forecasts(forecasts: dict[str, DataFrame], on: Sequence[str], pred: str = "pred") -> DataFrame:
    """Join several forecasts on identical scored rows; one column per model plus `actual` and `max_gap`.

    `max_gap` is the largest disagreement between the actuals the models were scored on.
    """
    out, seen = None, []
    for name, df in forecasts.items():
        part = df.select(*on, F.col(pred).alias(name), F.col("actual").alias(f"_actual_{name}"))
        seen.append(f"_actual_{name}")
        out = part if out is None else equi(out, part, list(on))
    gap = F.lit(0.0)
    for c in seen[1:]:
        gap = F.greatest(gap, F.abs(F.col(seen[0]) - F.col(c)))
    return out.withColumn("actual", F.col(seen[0])).withColumn("max_gap", gap).drop(*seen)


def require_aligned(aligned: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Fail the job on any row whose actuals disagree."""
    return aligned.withColumn(
        "actual",
        F.when(F.col("max_gap") <= tolerance, F.col("actual")).otherwise(
            F.raise_error(F.lit("forecasts are scored on different targets"))
        ),
    )
