"""Cleaning, filtering and calendar predicates on bars."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import as_col, equi, finite
from barloom.plans.panel import KEYS, running
from barloom.schemas import OHLCV

NEW_YORK = "America/New_York"
FINAL_AFTER = "16:30"
RAW_COLUMNS = ("open", "high", "low", "volume", "BB_Upper", "BB_Middle", "BB_Lower")


def validate_and_clean(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop all-null rows, forward fill, clip at zero, lift high to low."""
    kept = bars.na.drop(how="all", subset=list(OHLCV))
    filled = running(kept, {c: ("last", F.col(c)) for c in OHLCV}, keys, ["bar_date"])
    clipped = filled.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0))) for c in OHLCV})
    return clipped.withColumn("high", F.greatest("high", "low"))


def drop_raw_columns(df: DataFrame) -> DataFrame:
    return df.drop(*RAW_COLUMNS)


def select_date_range(df: DataFrame, start: str | None, end: str | None, order: str = "bar_date") -> DataFrame:
    if start:
        df = df.filter(F.col(order) >= F.lit(start).cast("date"))
    return df.filter(F.col(order) <= F.lit(end).cast("date")) if end else df


def drop_null_bars(df: DataFrame, cols: Iterable[str] = OHLCV) -> DataFrame:
    return df.na.drop(how="any", subset=list(cols))


def dedupe_keep_last(df: DataFrame, arrival: str, keys: Sequence[str] = (*KEYS, "bar_date")) -> DataFrame:
    """One row per key, the one with the highest arrival; combines map-side, so hot keys shrink first."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def session_is_final(day: Column | str, now: Column | str) -> Column:
    """A session is final before today (New York), or today from 16:30 on. `now` is a UTC timestamp."""
    local = F.from_utc_timestamp(as_col(now), NEW_YORK)
    today = F.to_date(local)
    return (as_col(day) < today) | ((as_col(day) == today) & (F.date_format(local, "HH:mm") >= FINAL_AFTER))


def final_session_filter(df: DataFrame, now: Column | str, order: str = "bar_date") -> DataFrame:
    return df.filter(session_is_final(order, now))


def next_session(d: Column | str) -> Column:
    """Next weekday; exchange holidays are not modelled."""
    d = as_col(d)
    return F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1))


def require_features(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")
    return df


def min_history_filter(df: DataFrame, floor: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep series with at least `floor` rows; the counts combine map-side."""
    keys = list(keys)
    long_enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= floor).drop("_n")
    return equi(df, long_enough, keys, "left_semi")


def finite_filter(df: DataFrame, c: str) -> DataFrame:
    return df.filter(finite(c).isNotNull())


def latest_rows(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "bar_date") -> DataFrame:
    """Newest row per series as a map-side-combined max."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in rest])


def top_rows(df: DataFrame, k: int, order: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """First k rows per key; the rank limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
