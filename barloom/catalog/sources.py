"""Scans, cleaning, joins and incremental ingest."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, MACRO, MACRO_LONG, PANEL, W, macro_wide, panel, query, rounded, rsql
from barloom.operators import clean, joins
from barloom.schemas import BARS as BARS_SCHEMA
from barloom.schemas import OHLCV
from barloom.sources import bars as src
from barloom.session import shared_folder
from barloom.sources import fixtures as fx
from barloom.sources import news

KEY = ("series_id", "bar_date")
ALL = "series_id, bar_date, open, high, low, close, volume"


def scratch(spark, name: str) -> str:
    """Folder for a written table, in the folder that the driver and the executors share."""
    return f"{shared_folder(spark)}/barloom-scratch/{name}-{os.urandom(6).hex()}"


@query("resample_ticks_to_bars", f"WITH {BARS} SELECT {ALL} FROM bars")
def _(spark, sf):
    return fx.bars_priority(spark, sf)


@query("bars_supplier", """SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS bar_date,
  round(arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey)), 8) AS open, round(max(l_extendedprice / l_quantity), 8) AS high,
  round(min(l_extendedprice / l_quantity), 8) AS low, round(arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey)), 8) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(fx.bars_supplier(spark, sf), 8, "open", "high", "low", "close")


_MARKET = BARS.replace("o_orderpriority", "'MARKET'")


@query("read_bars_csv", f"WITH {_MARKET} SELECT {ALL} FROM bars WHERE bar_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def _(spark, sf):
    path = scratch(spark, "bars-csv")
    src.write_csv(fx.bars_market(spark, sf).select(F.col("bar_date").alias("Date"), *[F.col(c).alias(c.upper()) for c in OHLCV]), path)
    return src.read_bars_csv(spark, ["/nonexistent/bars.csv", path], "1996-01-01", "2000-12-31")


@query("read_bars_csv_strict", f"WITH {_MARKET} SELECT {ALL} FROM bars WHERE bar_date <= DATE '1999-06-30'")
def _(spark, sf):
    path = scratch(spark, "bars-csv")
    src.write_csv(fx.bars_market(spark, sf).select(F.col("bar_date").alias("Date"), *[F.col(c).alias(c.title()) for c in OHLCV]), path)
    return src.read_bars_csv(spark, path, None, "1999-06-30", strict=True)


_FF = lambda c: f"last_value({c} IGNORE NULLS) OVER (ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("outer_join_series", f"WITH {MACRO_LONG} SELECT obs_date, {rsql(6, **{m: m for m in MACRO})} FROM macro")
def _(spark, sf):
    return rounded(joins.outer_join_series(fx.macro_long(spark, sf), MACRO), 6)


# names observed on different days, so that the wide table has gaps to fill
_SPARSE = ", ".join(f"CASE WHEN (date_diff('day', DATE '1970-01-01', obs_date) + {i}) % 3 <> 0 THEN {m} END AS {m}" for i, m in enumerate(MACRO))


def sparse_macro(spark, sf):
    i = F.array_position(F.array(*[F.lit(m) for m in MACRO]), F.col("name")) - 1
    return fx.macro_long(spark, sf).filter((F.unix_date("obs_date") + i) % 3 != 0)


@query("load_macro", f"""WITH {MACRO_LONG}, sparse AS (SELECT obs_date, {_SPARSE} FROM macro)
  SELECT obs_date, {rsql(6, **{m: _FF(m) for m in MACRO})} FROM sparse""")
def _(spark, sf):
    return rounded(src.load_macro(sparse_macro(spark, sf), MACRO), 6)


@query("read_macro_files", f"WITH {MACRO_LONG} SELECT name, obs_date, round(value, 6) AS value FROM macro UNPIVOT (value FOR name IN ({', '.join(MACRO)}))")
def _(spark, sf):
    files = {}
    long = fx.macro_long(spark, sf)
    for m in MACRO:  # one file per macro name, as the reader expects
        files[m] = scratch(spark, m)
        src.write_csv(long.filter(F.col("name") == m).select(F.col("obs_date").alias("Date"), F.col("value").alias("Close")), files[m])
    return rounded(src.read_macro_files(spark, files), 6)


_PAY = f"""pay AS (SELECT * FROM bars WHERE date_diff('day', DATE '1970-01-01', bar_date) % 17 <> 3)"""


@query("parse_chart_bars", f"WITH {BARS}, {_PAY} SELECT {ALL} FROM pay WHERE bar_date <= DATE '2001-03-14'")
def _(spark, sf):
    payloads = fx.chart_payload(fx.bars_priority(spark, sf))
    return src.parse_chart_bars(payloads, F.lit("2001-03-15 16:00:00").cast("timestamp"))


@query("final_session_filter", f"WITH {BARS} SELECT {ALL} FROM bars WHERE bar_date <= DATE '2001-03-15'")
def _(spark, sf):
    now = F.to_utc_timestamp(F.lit("2001-03-15 16:30:00").cast("timestamp"), clean.NEW_YORK)
    return clean.final_session_filter(fx.bars_priority(spark, sf), now)


@query("append_since_high_water", f"""WITH {BARS}, hist AS (SELECT * FROM bars WHERE bar_date < DATE '1998-01-01' AND series_id <> '5-LOW'),
  inc AS (SELECT series_id, bar_date, open, high, low, close + 1 AS close, volume FROM bars WHERE bar_date >= DATE '1997-06-01'),
  hw AS (SELECT series_id, max(bar_date) AS hw FROM hist GROUP BY 1)
  SELECT {ALL} FROM hist UNION ALL SELECT i.* FROM inc i LEFT JOIN hw USING (series_id) WHERE hw IS NULL OR i.bar_date > hw""")
def _(spark, sf):
    b = fx.bars_priority(spark, sf)
    hist = b.filter("bar_date < DATE '1998-01-01' AND series_id <> '5-LOW'")
    incoming = b.filter("bar_date >= DATE '1997-06-01'").withColumn("close", F.col("close") + 1)
    once = src.append_since_high_water(hist, incoming)
    return once


def _macro_parts(spark, sf):
    long = fx.macro_long(spark, sf)
    hist = long.filter("obs_date < DATE '1999-01-01'")
    incoming = long.filter("obs_date >= DATE '1998-07-01' AND name <> 'GLD'").withColumn("value", F.col("value") + 1)
    return hist, incoming


_EXT = ", ".join(f"CASE WHEN obs_date < DATE '1999-01-01' THEN {m} {'' if m == 'GLD' else f'ELSE {m} + 1'} END AS {m}" for m in MACRO)


@query("extend_macro_per_series", f"""WITH {MACRO_LONG}, ext AS (SELECT obs_date, {_EXT} FROM macro)
  SELECT obs_date, {rsql(6, **{m: _FF(m) for m in MACRO})} FROM ext""")
def _(spark, sf):
    return rounded(src.extend_macro(*_macro_parts(spark, sf), MACRO), 6)


@query("macro_refresh_errors", "SELECT 'GLD' AS name FROM lineitem LIMIT 1")
def _(spark, sf):
    return src.macro_errors(*_macro_parts(spark, sf))


@query("snapshot_provenance", f"""WITH {BARS}, {MACRO_LONG} SELECT max(bar_date) AS as_of, 'bundled+live' AS source,
  count(*) FILTER (bar_date >= DATE '1999-01-01') AS live_rows,
  'No new values, last ones carried forward: GLD' AS note,
  (SELECT CAST(max(CASE WHEN obs_date < DATE '1999-01-01' THEN obs_date END) AS VARCHAR) FROM macro) AS gold_as_of,
  (SELECT CAST(max(obs_date) AS VARCHAR) FROM macro) AS vix_as_of FROM bars""")
def _(spark, sf):
    b = fx.bars_priority(spark, sf)
    hist, inc = _macro_parts(spark, sf)
    macro = src.append_since_high_water(hist, inc, ["name"], "obs_date")
    out = src.snapshot_provenance(b.filter("bar_date < DATE '1999-01-01'"), b.filter("bar_date >= DATE '1999-01-01'"), macro, src.macro_errors(hist, inc))
    return out.select("as_of", "source", "live_rows", "note", F.col("macro_as_of")["GLD"].alias("gold_as_of"), F.col("macro_as_of")["VIX"].alias("vix_as_of"))


@query("recent_closes", f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY bar_date DESC) AS k FROM bars)
  SELECT series_id, row_number() OVER ({W}) - 1 AS pos, bar_date, round(close, 2) AS close FROM r WHERE k <= 60""")
def _(spark, sf):
    lists = src.recent_closes(fx.bars_priority(spark, sf))
    return lists.select("series_id", F.posexplode("recent").alias("pos", "_r")).select("series_id", F.col("pos").cast("long").alias("pos"), "_r.*")


@query("empty_with_schema", f"WITH {BARS} SELECT series_id, count(*) AS n FROM bars GROUP BY 1")
def _(spark, sf):
    """A source without rows unions cleanly: the schema is kept."""
    return fx.bars_priority(spark, sf).unionByName(src.empty_with_schema(spark, BARS_SCHEMA)).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("load_all", f"""WITH {BARS}, {MACRO_LONG} SELECT (SELECT count(*) FROM bars WHERE bar_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') AS bars,
  (SELECT count(*) FROM macro WHERE obs_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') AS macro, 0::BIGINT AS news""")
def _(spark, sf):
    b, m, n = src.load_all(fx.bars_priority(spark, sf), fx.macro_long(spark, sf), fx.news_events(spark, sf), "1997-01-01", "1999-12-31", MACRO)
    one = lambda d, c: d.agg(F.count(F.lit(1)).alias(c)).withColumn("_k", F.lit(1))
    return one(b, "bars").join(one(m, "macro"), "_k").join(one(n, "news"), "_k").drop("_k")


@query("parse_news_articles", """SELECT ts AS date, event_type || ' ' || props AS title, '' AS description, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS source,
  'event://' || CAST(event_id AS VARCHAR) AS url FROM events""")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    name = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    doc = F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("publishedAt"),
        F.concat_ws(" ", "event_type", "props").alias("title"), F.concat(F.lit("event://"), F.col("event_id").cast("string")).alias("url"),
        F.struct(name.alias("name")).alias("source"),
    )
    out = news.parse_news_articles(e.select(F.to_json(doc).alias("article")))
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("news_daily_digest", """WITH r AS (SELECT CAST(ts AS DATE) AS date, event_type || ' ' || props AS title,
    row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events)
  SELECT date, string_agg(title, ' | ' ORDER BY k) AS headlines FROM r WHERE k <= 10 GROUP BY 1""")
def _(spark, sf):
    return news.news_daily_digest(fx.news_events(spark, sf))


# --- cleaning
_GAPPY = ", ".join(f"CASE WHEN date_diff('day', DATE '1970-01-01', bar_date) % {p} <> 0 THEN {c} - {o} END AS {c}" for c, p, o in zip(OHLCV, (5, 7, 11, 13, 3), (60000, 90000, 0, 50000, 1)))


def gappy(spark, sf):
    """Bars with missing and negative values."""
    b = fx.bars_priority(spark, sf)
    return b.withColumns({c: F.when(F.unix_date("bar_date") % p != 0, F.col(c) - o) for c, p, o in zip(OHLCV, (5, 7, 11, 13, 3), (60000, 90000, 0, 50000, 1))})


_F = lambda c: f"last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_CLEAN = ", ".join(f"CASE WHEN {_F(c)} IS NOT NULL THEN greatest({_F(c)}, 0) END AS {c}" for c in OHLCV)


@query("validate_and_clean_bars", f"""WITH {BARS}, g AS (SELECT series_id, bar_date, {_GAPPY} FROM bars),
  c AS (SELECT series_id, bar_date, {_CLEAN} FROM g WHERE coalesce(open, high, low, close, volume) IS NOT NULL)
  SELECT series_id, bar_date, {rsql(4, open='open', high='greatest(high, low)', low='low', close='close')}, volume FROM c""")
def _(spark, sf):
    return rounded(clean.validate_and_clean(gappy(spark, sf)), 4, "open", "high", "low", "close")


@query("fill_forward_backward", f"""WITH {BARS}, g AS (SELECT series_id, bar_date, {_GAPPY} FROM bars)
  SELECT series_id, bar_date, {rsql(4, **{c: f"coalesce({_F(c)}, first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))" for c in OHLCV})} FROM g""")
def _(spark, sf):
    from barloom.operators.features import fill_forward_backward

    return rounded(fill_forward_backward(gappy(spark, sf), OHLCV, order=["bar_date"]).select(*KEY, *OHLCV), 4)


@query("finite_or_zero", f"""WITH {BARS} SELECT series_id, bar_date, round(CASE WHEN high = low THEN 0 ELSE (close - low) / (high - low) END, 8) AS ratio,
  0::DOUBLE AS nan_part FROM bars""")
def _(spark, sf):
    from barloom.functions.columns import finite_or_zero

    raw = F.when(F.col("high") == F.col("low"), float("inf")).otherwise((F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    return fx.bars_priority(spark, sf).select(*KEY, F.round(finite_or_zero(raw), 8).alias("ratio"), finite_or_zero(F.lit(float("nan")) * F.col("close")).alias("nan_part"))


@query("clip", f"WITH {BARS} SELECT series_id, bar_date, least(greatest(close, 50000), 200000) AS close FROM bars")
def _(spark, sf):
    from barloom.functions.columns import clip

    return fx.bars_priority(spark, sf).select(*KEY, clip("close", 50000, 200000).alias("close"))


@query("select_date_range", f"WITH {BARS} SELECT {ALL} FROM bars WHERE bar_date BETWEEN DATE '1996-02-03' AND DATE '1998-04-05'")
def _(spark, sf):
    return clean.select_date_range(fx.bars_priority(spark, sf), "1996-02-03", "1998-04-05")


@query("drop_null_bars", f"WITH {BARS}, g AS (SELECT series_id, bar_date, {_GAPPY} FROM bars) SELECT series_id, bar_date, {rsql(4, **{c: c for c in OHLCV})} FROM g WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL")
def _(spark, sf):
    return rounded(clean.drop_null_bars(gappy(spark, sf)), 4)


@query("dedupe_keep_last", """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS bar_date, max(o_orderkey) AS arrival, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("bar_date"), F.col("o_orderkey").alias("arrival"), F.col("o_totalprice").alias("close"))
    return clean.dedupe_keep_last(o, "arrival")


@query("next_session", f"""WITH {BARS} SELECT series_id, bar_date, CAST(bar_date + CAST(CASE isodow(bar_date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) AS DATE) AS next_date FROM bars""")
def _(spark, sf):
    return fx.bars_priority(spark, sf).select(*KEY, clean.next_session("bar_date").alias("next_date"))


@query("require_features", f"WITH {BARS} SELECT series_id, count(close) AS n FROM bars GROUP BY 1")
def _(spark, sf):
    return clean.require_features(fx.bars_priority(spark, sf), ["open", "close"]).groupBy("series_id").agg(F.count("close").alias("n"))


@query("min_history_filter", """WITH b AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, count(DISTINCT CAST(l_shipdate AS DATE)) AS n FROM lineitem GROUP BY 1)
  SELECT series_id, n FROM b WHERE n >= (SELECT avg(n) FROM b)""")
def _(spark, sf):
    b = fx.bars_supplier(spark, sf)
    floor = b.groupBy("series_id").count().agg(F.avg("count")).first()[0]
    return clean.min_history_filter(b, floor).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("finite_filter", f"WITH {BARS} SELECT series_id, count(*) AS n FROM bars WHERE high > low GROUP BY 1")
def _(spark, sf):
    b = fx.bars_priority(spark, sf).withColumn("x", F.when(F.col("high") > F.col("low"), F.col("close")).otherwise(float("nan")))
    return clean.finite_filter(b, "x").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


# --- joins
@query("asof_align", f"""WITH {BARS}, ev AS (SELECT series_id, bar_date AS obs_date, close AS level, volume AS depth FROM bars WHERE date_diff('day', DATE '1970-01-01', bar_date) % 9 = 4)
  SELECT b.series_id, b.bar_date, b.close, e.level, e.depth FROM bars b ASOF LEFT JOIN ev e ON b.series_id = e.series_id AND b.bar_date >= e.obs_date""")
def _(spark, sf):
    b = fx.bars_priority(spark, sf)
    ev = b.filter("unix_date(bar_date) % 9 = 4").select("series_id", F.col("bar_date").alias("obs_date"), F.col("close").alias("level"), F.col("volume").alias("depth"))
    return joins.asof_align(b.select(*KEY, "close"), ev, ["level", "depth"])


@query("align_macro", f"""WITH {BARS}, {MACRO_LONG} SELECT b.series_id, b.bar_date, {rsql(6, **{m: m for m in MACRO})} FROM bars b ASOF LEFT JOIN macro m ON b.bar_date >= m.obs_date""")
def _(spark, sf):
    return rounded(joins.align_macro(fx.bars_priority(spark, sf).select(*KEY), macro_wide(spark, sf)), 6)


@query("append_union", f"WITH {BARS} SELECT {ALL} FROM bars")
def _(spark, sf):
    b = fx.bars_priority(spark, sf)
    return b.filter("bar_date < DATE '1998-01-01'").unionByName(b.filter("bar_date >= DATE '1998-01-01'").select(*reversed(b.columns)))


@query("row_index", f"WITH {PANEL} SELECT series_id, bar_date, row_idx, n_rows FROM panel")
def _(spark, sf):
    return panel(spark, sf).select(*KEY, "row_idx", "n_rows")


def neighbour_pairs(b):
    """(a, b): each series with the next one by name."""
    from pyspark.sql import Window

    ids = b.select("series_id").distinct().withColumn("_all", F.lit(0))
    nxt = ids.withColumn("b", F.lead("series_id").over(Window.partitionBy("_all").orderBy("series_id")))
    return nxt.filter("b IS NOT NULL").select(F.col("series_id").alias("a"), "b")


PAIRS = """ids AS (SELECT DISTINCT series_id FROM bars), pairs AS (SELECT * FROM (SELECT series_id AS a, lead(series_id) OVER (ORDER BY series_id) AS b FROM ids) WHERE b IS NOT NULL),
  pr AS (SELECT p.a, p.b, y.bar_date, y.close AS y, x.close AS x FROM pairs p JOIN bars y ON y.series_id = p.a JOIN bars x ON x.series_id = p.b AND x.bar_date = y.bar_date)"""


@query("series_pairs", f"WITH {BARS}, {PAIRS} SELECT a, b, bar_date, y, x FROM pr")
def _(spark, sf):
    b = fx.bars_priority(spark, sf)
    return joins.series_pairs(b, neighbour_pairs(b))


@query("write_report", f"WITH {BARS} SELECT series_id, count(*) AS n, round(avg(close), 4) AS mean_close FROM bars GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "report")
    g = fx.bars_priority(spark, sf).groupBy("series_id").agg(F.struct(F.count(F.lit(1)).alias("n"), F.round(F.avg("close"), 4).alias("mean_close")).alias("metrics"))
    src.write_report(g, path)
    return spark.read.schema("series_id string, metrics struct<n: bigint, mean_close: double>").json(path).select("series_id", "metrics.*")
