"""Streaming queries: the events table drained through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import query, rounded
from barloom.catalog.features import ema_cte
from barloom.catalog.sources import scratch
from barloom.operators import drift
from barloom.operators.regime import Params
from barloom.sources import fixtures as fx
from barloom.streaming import bars as st

PINNED = Params((0.5, 0.5), (0.95, 0.05, 0.1, 0.9), (30.0, 90.0), (400.0, 3600.0))


def _drain(spark, stream, name):
    base = scratch(spark, name)
    return st.run_available(stream, f"{base}/out", f"{base}/checkpoint")


@query("stream_bars", """WITH e AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS bar_date, ts, value FROM events)
  SELECT series_id, bar_date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM e
  WHERE bar_date + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    return _drain(spark, st.stream_bars(st.read_table_stream(spark, sf, "events"), "event_type", "ts", "value"), "bars")


@query("stream_append_final", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS session, ts, value FROM events)
  SELECT user_id, session, arg_max(value, ts) AS value FROM e WHERE session + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 16 HOUR - INTERVAL 30 MINUTE FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    s = st.stream_append_final(st.read_table_stream(spark, sf, "events"), "ts", "16 hours 30 minutes", ["user_id"], "value")
    return _drain(spark, s, "final").drop("last_ts")


@query("stream_dedupe", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events")
def _(spark, sf):
    """Every row sent twice comes out once."""
    s = st.read_table_stream(spark, sf, "events").select("event_id", "ts").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = _drain(spark, st.stream_dedupe(s, ["event_id"], "ts"), "dedupe")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("stream_dedupe_last", "SELECT event_id, 2 AS copy FROM events")
def _(spark, sf):
    base = scratch(spark, "dedupe-last")
    s = st.read_table_stream(spark, sf, "events").select("event_id", "ts").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    st.run_batches(s, st.dedupe_last_batch(["event_id"], "copy", f"{base}/out"), f"{base}/checkpoint")
    return st.read_last(spark, f"{base}/out", ["event_id"], "copy").select("event_id", "copy")


@query("stream_ema", f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT event_type AS series_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS row_idx FROM events),
  {ema_cte('m', 'ev', 'value', '(2.0::DOUBLE / 13)', 'y')} SELECT series_id AS event_type, ev.ts, round(m.y, 6) AS ema FROM m JOIN ev USING (series_id, row_idx)""")
def _(spark, sf):
    out = _drain(spark, st.stream_ema(st.read_table_stream(spark, sf, "events"), "event_type", "ts", "value", 12), "ema")
    return rounded(out.select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "ema"), 6)


@query("stream_hmm_filter", """WITH RECURSIVE ev AS MATERIALIZED (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS k,
    -0.5::DOUBLE * (ln(2 * pi() * 400) + (value - 30) * (value - 30) / 400) AS l0, -0.5::DOUBLE * (ln(2 * pi() * 3600) + (value - 90) * (value - 90) / 3600) AS l1 FROM events),
  eb AS MATERIALIZED (SELECT event_type, ts, k, exp(l0 - greatest(l0, l1)) AS b0, exp(l1 - greatest(l0, l1)) AS b1 FROM ev),
  f AS (SELECT event_type, k, b0 / (b0 + b1) AS p0 FROM eb WHERE k = 0
    UNION ALL SELECT e.event_type, e.k, (f.p0 * 0.95 + (1 - f.p0) * 0.1) * b0 / ((f.p0 * 0.95 + (1 - f.p0) * 0.1) * b0 + (f.p0 * 0.05 + (1 - f.p0) * 0.9) * b1)
    FROM f JOIN eb e ON e.event_type = f.event_type AND e.k = f.k + 1)
  SELECT event_type, ts, round(1 - p0, 6) AS p_high FROM f JOIN eb USING (event_type, k)""")
def _(spark, sf):
    s = st.stream_hmm_filter(st.read_table_stream(spark, sf, "events"), "event_type", "ts", ["value"], PINNED)
    out = _drain(spark, s, "hmm")
    return rounded(out.select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("filtered")[1].alias("p_high")), 6)


_P = [i / 10 for i in range(11)]


@query("stream_psi", f"""WITH lg AS (SELECT event_type AS feature, value, event_id % 2 = 0 AS is_reference FROM events),
  q AS (SELECT feature, list_distinct(quantile_cont(value, {_P})) AS e FROM lg WHERE is_reference GROUP BY 1),
  edges AS (SELECT feature, list_sort(e)[2:len(e) - 1] AS inner_edges FROM q),
  bk AS (SELECT l.feature, l.is_reference, len(list_filter(e.inner_edges, lambda x: x <= l.value)) AS bucket, count(*) AS n FROM lg l JOIN edges e USING (feature) GROUP BY ALL),
  al AS (SELECT e.feature, unnest(range(len(e.inner_edges) + 1)) AS bucket FROM edges e),
  ct AS (SELECT al.*, coalesce(r.n, 0) AS rn, coalesce(c.n, 0) AS cn FROM al LEFT JOIN bk r ON r.feature = al.feature AND r.bucket = al.bucket AND r.is_reference
    LEFT JOIN bk c ON c.feature = al.feature AND c.bucket = al.bucket AND NOT c.is_reference),
  p1 AS (SELECT *, greatest(rn / sum(rn) OVER k, 1e-4) AS p, greatest(cn / sum(cn) OVER k, 1e-4) AS q FROM ct WINDOW k AS (PARTITION BY feature)),
  p2 AS (SELECT *, p / sum(p) OVER k AS pn, q / sum(q) OVER k AS qn FROM p1 WINDOW k AS (PARTITION BY feature))
  SELECT feature, round(sum((qn - pn) * ln(qn / pn)), 8) AS psi, CAST(sum(cn) AS BIGINT) AS n_current FROM p2 GROUP BY 1""")
def _(spark, sf):
    base = scratch(spark, "psi")
    e = fx.table(spark, sf, "events").select(F.col("event_type").alias("feature"), "value", "event_id")
    reference = e.filter("event_id % 2 = 0").select("feature", "value")
    drift.psi_edges(reference, ["feature"]).write.parquet(f"{base}/edges")
    edges = spark.read.parquet(f"{base}/edges")
    drift.bucket_counts(reference.withColumn("is_reference", F.lit(True)), edges, ["feature"]).write.parquet(f"{base}/counts")
    counts = spark.read.parquet(f"{base}/counts")
    live = st.read_table_stream(spark, sf, "events").filter("event_id % 2 = 1").select(F.col("event_type").alias("feature"), "value")
    st.run_batches(live, st.psi_batch(edges, ["feature"], f"{base}/out"), f"{base}/checkpoint")
    return rounded(st.read_psi(spark, f"{base}/out", counts, ["feature"]).select("feature", "psi", "n_current"), 8)


@query("stream_forecast", """WITH ev AS (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS prev FROM events),
  p AS (SELECT event_type, regr_slope(value, prev) AS b, regr_intercept(value, prev) AS a FROM ev WHERE prev IS NOT NULL GROUP BY 1),
  l AS (SELECT event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY 1), r AS (SELECT l.*, (a + b * value - value) / value AS fr FROM l JOIN p USING (event_type))
  SELECT event_type, ts, value, round(fr, 6) AS forecast_return, round(value * (1 + fr), 6) AS predicted, CASE WHEN abs(fr) < 0.002 THEN 'HOLD' WHEN fr > 0 THEN 'BUY' ELSE 'SELL' END AS signal FROM r""")
def _(spark, sf):
    from barloom.operators.econometrics import ar1_residuals
    from barloom.plans.panel import row_index

    base = scratch(spark, "forecast")
    e = row_index(fx.table(spark, sf, "events").select("event_type", "ts", "value"), ["event_type"], "ts")
    fit = ar1_residuals(e, "value", ["event_type"]).select("event_type", "slope", "intercept").distinct()
    fit.write.parquet(f"{base}/params")
    sink = st.forecast_batch(spark.read.parquet(f"{base}/params"), f"{base}/out", "event_type", "ts", "value")
    st.run_batches(st.read_table_stream(spark, sf, "events"), sink, f"{base}/checkpoint")
    out = st.read_newest(spark, f"{base}/out", ["event_type"], "ts")
    return rounded(out, 6, "forecast_return", "predicted")
