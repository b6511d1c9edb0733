"""Adapters from the warehouse tables to panel inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import resample_ticks_to_bars

MACRO_AGGREGATES = {
    "VIX": lambda: F.avg("l_quantity"),
    "TNX": lambda: 100.0 * F.avg("l_discount"),
    "IRX": lambda: 100.0 * F.avg("l_tax"),
    "DXY": lambda: F.sum("l_extendedprice") / 1000.0,
    "GLD": lambda: F.max("l_extendedprice") / 100.0,
    "TLT": lambda: F.min("l_extendedprice") / 10.0,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals, one series per order priority."""
    o = table(spark, sf_dir, "orders")
    return resample_ticks_to_bars(
        o.select("o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice"),
        series="o_orderpriority", ts="o_orderdate", value="o_totalprice", tie="o_orderkey",
    )


def bars_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of all orders as one series."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return resample_ticks_to_bars(
        o.withColumn("series", F.lit("MARKET")), series="series", ts="o_orderdate", value="o_totalprice", tie="o_orderkey"
    )


def bars_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices per supplier; volume is the quantity shipped."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("series"),
        "l_shipdate",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("tie"),
    )
    return resample_ticks_to_bars(li, series="series", ts="l_shipdate", value="price", tie="tie", volume="l_quantity")


def bars_event_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values per event type (bar_ts instead of bar_date)."""
    e = table(spark, sf_dir, "events").withColumn("bar_ts", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return resample_ticks_to_bars(
        e, series="event_type", ts="ts", value="value", tie="ts", bar=F.col("bar_ts"), bar_name="bar_ts"
    )


def macro_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, obs_date, value - one aggregate of the day's line items per macro name."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("obs_date"))
    wide = li.agg(*[make().alias(n) for n, make in MACRO_AGGREGATES.items()])
    return wide.unpivot(["obs_date"], list(MACRO_AGGREGATES), "name", "value").select("name", "obs_date", "value")


def news_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("date"),
        F.concat_ws(" ", "event_type", "props").alias("title"),
        F.col("props").alias("description"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("event://"), F.col("event_id").cast("string")).alias("url"),
    )


def chart_payload(bars: DataFrame) -> DataFrame:
    """series_id, month, payload: one chart JSON per series and month; some null fields are injected.

    A month of daily bars bounds each payload.
    """
    stamp = (F.unix_date("bar_date").cast("long") * 86400 + 14 * 3600).alias("t")
    broken = F.unix_date("bar_date") % 17 == 3
    rows = bars.withColumn("low", F.when(~broken, F.col("low"))).select(
        "series_id", F.trunc("bar_date", "month").alias("month"), F.struct(stamp, "open", "high", "low", "close", "volume").alias("r")
    )
    grouped = rows.groupBy("series_id", "month").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    column = lambda c: F.transform("rs", lambda r: r[c]).alias(c)
    body = F.struct(
        column("t").alias("timestamp"),
        F.struct(F.lit(-18000).cast("long").alias("gmtoffset")).alias("meta"),
        F.struct(F.array(F.struct(*[column(c) for c in ("open", "high", "low", "close", "volume")])).alias("quote")).alias("indicators"),
    )
    return grouped.select("series_id", "month", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, label: quality and toxicity as sentiment classes."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return d.join(lab, "doc_id").select("doc_id", "text", "lang", label.alias("label"))
