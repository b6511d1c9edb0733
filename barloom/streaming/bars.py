"""Structured Streaming forms of ingest, indicators, drift and scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.blend import predicted_price, signal_label
from barloom.operators.clean import dedupe_keep_last, latest_rows
from barloom.operators.drift import bucket_counts, psi_from_counts, with_status
from barloom.operators.regime import Params, step_matrices


FILES_PER_TRIGGER = 64
SLICE = 1 << 14  # rows of a key that a stateful step hands on at a time


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """One parquet table of a folder as a stream; a micro-batch takes at most `files_per_trigger` files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available into parquet and read it back; restarts continue from the checkpoint."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def stream_bars(ticks: DataFrame, series: str, ts: str, value: str, delay: str = "30 minutes", width: str = "1 day") -> DataFrame:
    """Session bars in append mode: a bar is emitted once, when its session is final.

    `delay` is the finality delay; rows for emitted sessions arriving later are dropped. The aggregate
    keeps one small state row per open session and series.
    """
    timed = ticks.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    bars = timed.groupBy(F.window("_ts", width), F.col(series).cast("string").alias("series_id")).agg(
        F.min_by(value, "_ts").alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, "_ts").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return bars.select("series_id", F.to_date("window.start").alias("bar_date"), "open", "high", "low", "close", "volume")


def stream_append_final(incoming: DataFrame, ts: str, delay: str, keys: Sequence[str], value: str, width: str = "1 day") -> DataFrame:
    """Final sessions only: the last value per key and session, each emitted once."""
    timed = incoming.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    g = timed.groupBy(F.window("_ts", width), *keys).agg(F.max_by(value, "_ts").alias(value), F.max("_ts").alias("last_ts"))
    return g.select(*keys, F.to_date("window.start").alias("session"), value, "last_ts")


def stream_dedupe(incoming: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 day") -> DataFrame:
    """One row per key within the watermark, any copy."""
    return incoming.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def dedupe_last_batch(keys: Sequence[str], arrival: str, target: str):
    """foreachBatch sink where the last copy of a key wins across batches.

    Each batch writes its winners under its own id, so a repeated batch overwrites itself; readers take
    the latest per key with `read_last`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        dedupe_keep_last(batch, arrival, keys).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def read_last(spark: SparkSession, target: str, keys: Sequence[str], arrival: str) -> DataFrame:
    return dedupe_keep_last(spark.read.parquet(target).drop("batch"), arrival, keys)


def _newer(frames: Iterator[pd.DataFrame], ts: str, cols: Sequence[str], last) -> tuple[np.ndarray, np.ndarray]:
    """Times and numbers of the key's rows of this micro-batch in time order, without rows before the stored time. Ties stay:
    a row of the stored time that comes in a later batch follows those already taken.

    Frames come one after the other and only 8 bytes a number are kept of them."""
    times, values = bytearray(), bytearray()
    for f in frames:
        f = f if last is None else f[f[ts] >= pd.Timestamp(last)]
        times += f[ts].to_numpy(dtype="datetime64[ns]").tobytes()
        values += f[list(cols)].to_numpy(dtype=float).tobytes()
    t, x = np.frombuffer(times, dtype="datetime64[ns]"), np.frombuffer(values, dtype=float).reshape(-1, len(cols))
    order = None if (t[1:] >= t[:-1]).all() else np.argsort(t, kind="stable")  # no time: last
    return (t, x) if order is None else (t[order], x[order])


def _stored_time(t: np.ndarray):
    """The newest time as the state keeps it."""
    newest = t.max() if not np.isnat(t[-1]) else np.fmax.reduce(t)
    return None if np.isnat(newest) else pd.Timestamp(newest).to_pydatetime()


def _frames(name, t: np.ndarray, x: np.ndarray, src: T.StructType, of, result: str) -> Iterator[pd.DataFrame]:
    """Rows and `of(from, to)` under the name `result`, SLICE rows at a time."""
    key, ts, *cols = src.fieldNames()
    for at in range(0, len(t), SLICE):
        to = min(at + SLICE, len(t))
        data = {key: [name[0]] * (to - at), ts: t[at:to]} | {c: x[at:to, i] for i, c in enumerate(cols)}
        yield pd.DataFrame(data | {result: of(at, to)})


def stream_ema(stream: DataFrame, key: str, ts: str, value: str, span: int) -> DataFrame:
    """Exponential average continued over micro-batches; equals the batch value on the same rows.

    State per key is (last time, average). The micro-batch size bounds what a task sorts.
    """
    alpha = 2.0 / (span + 1)
    src = stream.select(key, F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value))
    out = T.StructType([*src.schema.fields, T.StructField("ema", T.DoubleType())])
    state_schema = T.StructType([T.StructField("last", T.TimestampType()), T.StructField("y", T.DoubleType())])
    schema = src.schema

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, y = state.get if state.exists else (None, None)
        t, x = _newer(frames, ts, [value], last)
        if not len(t):
            return
        chain = x[:, 0] if y is None else np.concatenate([[y], x[:, 0]])
        ema = pd.Series(chain).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(chain) - len(x) :]
        del chain
        state.update((_stored_time(t), float(ema[-1])))
        yield from _frames(k, t, x, schema, lambda a, b: ema[a:b], "ema")

    return src.groupBy(key).applyInPandasWithState(step, out, state_schema, "append", "NoTimeout")


def stream_hmm_filter(stream: DataFrame, key: str, ts: str, cols: Sequence[str], params: Params) -> DataFrame:
    """Forward regime filter continued over micro-batches; state per key is the last posterior.

    A task holds 8 bytes a number of a key's rows in a micro-batch and filters SLICE rows at a time.
    """
    from barloom.operators.regime import forward

    src = stream.select(key, F.col(ts).cast("timestamp").alias(ts), *[F.col(c).cast("double").alias(c) for c in cols])
    k = len(params.start)
    out = T.StructType([*src.schema.fields, T.StructField("filtered", T.ArrayType(T.DoubleType()))])
    state_schema = T.StructType([T.StructField("last", T.TimestampType()), T.StructField("alpha", T.ArrayType(T.DoubleType()))])
    schema = src.schema

    def step(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, alpha = state.get if state.exists else (None, None)
        t, x = _newer(frames, ts, cols, last)
        if not len(t):
            return

        def filtered(a: int, b: int) -> list[np.ndarray]:
            nonlocal alpha
            m, _ = step_matrices(np.nan_to_num(x[a:b]), params, alpha is None)
            post = forward(np.full(k, 1.0 / k) if alpha is None else np.asarray(alpha), m)
            alpha = [float(v) for v in post[-1]]
            return list(post)

        yield from _frames(name, t, x, schema, filtered, "filtered")
        state.update((_stored_time(t), alpha))

    return src.groupBy(key).applyInPandasWithState(step, out, state_schema, "append", "NoTimeout")


def psi_batch(edges: DataFrame, by: Sequence[str], target: str):
    """foreachBatch sink: bucket counts of each live batch against stored edges; `read_psi` adds the batches up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        bucket_counts(batch.withColumn("is_reference", F.lit(False)), edges, by).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def read_psi(spark: SparkSession, target: str, reference_counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per key: PSI of all live batches so far against the reference counts."""
    live = spark.read.parquet(target).drop("batch")
    return with_status(psi_from_counts(reference_counts.unionByName(live), by)).filter("n_current > 0")


def read_newest(spark: SparkSession, target: str, keys: Sequence[str], ts: str) -> DataFrame:
    """One row per key of a sink that writes a result a batch: the newest, of the latest batch among equal times."""
    rows = spark.read.parquet(target)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(ts, "batch")).alias("_r")).select(*keys, "_r.*").drop("batch")


def forecast_batch(params: DataFrame, target: str, key: str, ts: str, value: str):
    """foreachBatch sink: newest row per series of the batch scored with stored one-lag parameters."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest_rows(batch.select(key, ts, value), [key], ts)
        scored = newest.join(params, key, "left")
        forecast = F.col("intercept") + F.col("slope") * F.col(value)
        ret = F.try_divide(forecast - F.col(value), F.col(value))
        out = scored.withColumns({"forecast_return": ret}).withColumns(
            {"predicted": predicted_price(value, "forecast_return"), "signal": signal_label("forecast_return")}
        )
        out.drop("slope", "intercept").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def run_batches(stream: DataFrame, sink, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
