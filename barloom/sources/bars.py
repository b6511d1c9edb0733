"""Bar and macro sources: files, chart payloads, tick resampling, incremental append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import as_col, equi
from barloom.operators.clean import dedupe_keep_last, final_session_filter, select_date_range, validate_and_clean
from barloom.operators.joins import ffill_dates, outer_join_series
from barloom.plans.panel import KEYS
from barloom.schemas import BARS, CHART_PAYLOAD, OHLCV

DATE_HEADERS = ("date", "datetime", "timestamp", "time")


def resample_ticks_to_bars(
    ticks: DataFrame, series: str, ts: str, value: str, tie: str, volume: str | None = None,
    bar: Column | None = None, bar_name: str = "bar_date",
) -> DataFrame:
    """One OHLCV bar per (series, day). `tie` orders ticks inside a bar and must be unique there.

    A single map-side-combined aggregation, so a hot series or day shrinks before the shuffle.
    """
    day = bar if bar is not None else F.to_date(ts)
    size = F.sum(F.col(volume).cast("double")) if volume else F.count(F.lit(1)).cast("double")
    return ticks.groupBy(F.col(series).cast("string").alias("series_id"), day.alias(bar_name)).agg(
        F.min_by(value, tie).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, tie).alias("close"),
        size.alias("volume"),
    )


def _existing(spark: SparkSession, paths: Sequence[str]) -> str:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(f"none of {list(paths)} exists")


def _csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """All-string frame with lower-case headers; only the header line is read to learn the names."""
    raw = spark.read.option("header", True).csv(path)
    names = [c.strip().lower() for c in raw.columns]
    return raw.toDF(*names), names


def read_bars_csv(
    spark: SparkSession, paths: str | Sequence[str], start: str | None = None, end: str | None = None,
    series_id: str = "MARKET", strict: bool = False,
) -> DataFrame:
    """Bars from the first existing CSV path.

    The date column is the first header containing "date", else the first one. strict=True demands a
    known date header, all OHLCV columns and a non-empty range, and cleans the bars.
    """
    df, names = _csv(spark, _existing(spark, [paths] if isinstance(paths, str) else list(paths)))
    if strict:
        found = [c for c in names if c in DATE_HEADERS]
        missing = [c for c in OHLCV if c not in names]
        if not found:
            raise ValueError(f"no date column among {names}")
        if missing:
            raise ValueError(f"missing required columns: {missing}")
        date = found[0]
    else:
        date = next((c for c in names if "date" in c), names[0])
    # an offset after the day part ("... 00:00:00-05:00") must not move the date
    parsed = df.select(
        F.lit(series_id).alias("series_id"),
        F.expr(f"try_cast(substring(`{date}`, 1, 10) AS date)").alias("bar_date"),
        *[F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in names else F.lit(None).cast("double").alias(c) for c in OHLCV],
    )
    if not strict:
        present = [c for c in OHLCV if c in names]
        return select_date_range(parsed.na.drop(how="any", subset=["bar_date", *present]), start, end)
    bars = select_date_range(parsed.filter("bar_date IS NOT NULL"), start, end)
    if bars.limit(1).count() == 0:
        raise ValueError(f"no rows between {start} and {end}")
    return validate_and_clean(bars)


def read_macro_files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Long macro observations; one close series per file, files without data drop out."""
    out = empty_with_schema(spark, T.StructType().add("name", "string").add("obs_date", "date").add("value", "double"))
    for name, path in files.items():  # one lazy scan per macro name, unioned
        df, names = _csv(spark, path)
        date = next((c for c in names if "date" in c), names[0])
        out = out.unionByName(
            df.select(
                F.lit(name).alias("name"),
                F.expr(f"try_cast(substring(`{date}`, 1, 10) AS date)").alias("obs_date"),
                F.expr("try_cast(close AS double)").alias("value"),
            ).na.drop()
        )
    return out


def load_macro(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide macro table: outer join on date, sorted fill-forward, one column per name."""
    return ffill_dates(outer_join_series(long, names), names)


def parse_chart_bars(
    payloads: DataFrame, now: Column, after: Column | str | None = None, payload: str = "payload",
    keys: Sequence[str] = KEYS, fields: Sequence[str] = OHLCV,
) -> DataFrame:
    """Bars from chart JSON: zip the parallel arrays, skip entries with a null field, date by the
    exchange offset, keep final sessions after the high-water date, last entry per date wins."""
    doc = payloads.withColumn("_doc", F.from_json(payload, CHART_PAYLOAD))
    quote = F.get(F.col("_doc.indicators.quote"), F.lit(0))
    zipped = F.arrays_zip(F.col("_doc.timestamp").alias("t"), *[quote[c].alias(c) for c in fields])
    rows = doc.withColumn("_offset", F.coalesce("_doc.meta.gmtoffset", F.lit(0))).select(
        *payloads.columns, "_offset", F.posexplode(zipped).alias("_pos", "_bar")
    )
    day = F.date_from_unix_date(F.floor((F.col("_bar.t") + F.col("_offset")) / 86400).cast("int"))
    bars = rows.select(
        *keys, day.alias("bar_date"), *[F.col(f"_bar.{c}").alias(c) for c in fields], F.struct("_bar.t", "_pos").alias("_arrival"),
        *([as_col(after).alias("_after")] if after is not None else []),
    ).na.drop(how="any", subset=["bar_date", *fields])
    if after is not None:
        bars = bars.filter(F.col("bar_date") > F.col("_after")).drop("_after")
    return dedupe_keep_last(final_session_filter(bars, now), "_arrival", (*keys, "bar_date")).drop("_arrival")


def high_water(history: DataFrame, keys: Sequence[str] = KEYS, order: str = "bar_date") -> DataFrame:
    return history.groupBy(*keys).agg(F.max(order).alias("_hw"))


def newer_than(history: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS, order: str = "bar_date") -> DataFrame:
    """Incoming rows strictly after their series' last stored date (all rows of a new series)."""
    marked = equi(incoming, high_water(history, keys, order), list(keys), "left")
    return marked.filter(F.col("_hw").isNull() | (F.col(order) > F.col("_hw"))).drop("_hw")


def append_since_high_water(history: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS, order: str = "bar_date") -> DataFrame:
    """History plus strictly newer rows; appending the same rows twice changes nothing."""
    return history.unionByName(newer_than(history, incoming, keys, order))


def extend_macro(history: DataFrame, incoming: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per-name high-water append, then the wide forward-filled table with a fixed column order."""
    return load_macro(append_since_high_water(history, incoming, ["name"], "obs_date"), names)


def macro_errors(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Names that got no incoming rows; they keep their old values."""
    return history.select("name").distinct().join(incoming.select("name").distinct(), "name", "left_anti")


def snapshot_provenance(history: DataFrame, live: DataFrame, macro: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: as_of, source, live_rows, note and the last date per macro name."""
    both = history.select("bar_date", F.lit(0).alias("_live")).unionByName(live.select("bar_date", F.lit(1).alias("_live")))
    top = both.agg(F.max("bar_date").alias("as_of"), F.sum("_live").alias("live_rows")).withColumn("_one", F.lit(1))
    per_name = macro.groupBy("name").agg(F.max("obs_date").alias("d"))
    as_of = per_name.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.col("d").cast("string"))))).alias("macro_as_of")
    ).withColumn("_one", F.lit(1))
    out = top.join(as_of, "_one")
    if errors is not None:
        stale = errors.agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("_stale")).withColumn("_one", F.lit(1))
        note = F.concat(F.lit("No new values, last ones carried forward: "), F.col("_stale"))
        out = out.join(stale, "_one").withColumn("note", F.when(F.col("_stale") != "", note)).drop("_stale")
    else:
        out = out.withColumn("note", F.lit(None).cast("string"))
    source = F.when(F.col("live_rows") > 0, "bundled+live").otherwise("bundled")
    return out.select("as_of", source.alias("source"), "live_rows", "note", "macro_as_of")


def recent_closes(bars: DataFrame, k: int = 60, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last k (date, close to 2 decimals) per series, oldest first."""
    from barloom.operators.clean import top_rows

    last = top_rows(bars, k, F.col("bar_date").desc(), keys)
    point = F.struct("bar_date", F.round("close", 2).alias("close"))
    return last.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("recent"))


def empty_with_schema(spark: SparkSession, schema: T.StructType = BARS) -> DataFrame:
    return spark.createDataFrame([], schema)


def load_all(bars: DataFrame, macro: DataFrame, news: DataFrame, start: str, end: str, names: Sequence[str],
             include_news: bool = True, include_macro: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, macro, news) in the range, all lazy; a source left out comes back empty with its schema."""
    spark = bars.sparkSession
    day = F.to_date("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    wide = load_macro(select_date_range(macro, start, end, "obs_date"), names)
    return (
        select_date_range(bars, start, end),
        wide if include_macro else empty_with_schema(spark, wide.schema),
        news.filter(day) if include_news else empty_with_schema(spark, news.schema),
    )


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
