"""Counting many columns at once in one vectorised pass over wide rows, against a small table of numbers per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BYTES = 64 << 20
FLUSH = 4096


def per_key_arrays(batch: pa.RecordBatch, keys: Sequence[str], cols: Sequence[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, its rows of every column): NULL and non-finite numbers become NaN."""
    names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
    codes: dict[tuple, int] = {}
    of = np.fromiter((codes.setdefault(n, len(codes)) for n in names), dtype=np.int64, count=len(names))
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(codes)))
    values = [np.where(np.isfinite(v), v, np.nan)[order] for v in (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols)]
    for key, a, b in zip(codes, [0, *ends], ends):
        yield key, [v[a:b] for v in values]


def count_pass(df: DataFrame, keys: Sequence[str], cols: Sequence[str], places: dict[tuple, list], n_places: int, place: Callable, inside: Callable | None = None) -> DataFrame:
    """keys, feature, _j, value, n: rows per place of each column, and the values that `inside` picks.

    `places[key][i]` holds the numbers of column i, or None; `place(values, numbers)` gives the place of each value;
    `inside(values, places, numbers)` marks values that are handed on one by one.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(places)
    keys, cols = list(keys), list(cols)
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def rows(key_rows: list[tuple], feature, j, value, n) -> pa.RecordBatch:
            arrays = [pa.array([k[i] for k in key_rows], t) for i, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(feature, pa.string()), pa.array(j, pa.int32()), pa.array(value, pa.float64()), pa.array(n, pa.int64())], [*keys, "feature", "_j", "value", "n"])

        def flushed() -> pa.RecordBatch:
            out = [(key, *at) for key, t in totals.items() for at in zip(*np.nonzero(t))]
            counts = [int(totals[key][i, j]) for key, i, j in out]
            return rows([o[0] for o in out], [cols[o[1]] for o in out], [int(o[2]) for o in out], [None] * len(out), counts)

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            picked: list[tuple] = []
            for key, columns in per_key_arrays(batch, keys, cols):
                numbers = shared.value.get(key)
                if numbers is None:
                    continue
                total = totals.setdefault(key, np.zeros((len(cols), n_places), dtype=np.int64))
                for i, v in enumerate(columns):
                    if numbers[i] is None:
                        continue
                    v = v[~np.isnan(v)]
                    j = place(v, numbers[i])
                    if inside is not None:
                        own = inside(v, j, numbers[i])
                        if own.any():
                            picked.append((key, cols[i], j[own], v[own]))
                            j = j[~own]
                    total[i] += np.bincount(j, minlength=n_places)
            if picked:
                sizes = [len(p[2]) for p in picked]
                yield rows(
                    [p[0] for p, s in zip(picked, sizes) for _ in range(s)], [p[1] for p, s in zip(picked, sizes) for _ in range(s)],
                    np.concatenate([p[2] for p in picked]).astype(np.int32), np.concatenate([p[3] for p in picked]), np.ones(sum(sizes), dtype=np.int64),
                )
            if len(totals) > FLUSH:
                yield flushed()
                totals = {}
        if totals:
            yield flushed()

    return df.select(*keys, *cols).mapInArrow(run, f"{fields}{', ' if fields else ''}feature string, _j int, value double, n bigint")


def moments_pass(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """keys, feature, n, mean, m2, low, high of the finite values of every column, some rows per key and task.

    m2 is the sum of squares about the row's own mean: rows of a key merge without cancellation.
    """
    keys, cols = list(keys), list(cols)
    fields = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def flushed() -> pa.RecordBatch:
            rows = [(key, i, *t) for key, own in held.items() for i, t in enumerate(own) if t[0]]
            arrays = [pa.array([r[0][i] for r in rows], t) for i, t in enumerate(kinds)]
            values = [pa.array([r[j] for r in rows], pa.float64()) for j in range(3, 7)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([cols[r[1]] for r in rows], pa.string()), pa.array([int(r[2]) for r in rows], pa.int64()), *values], [*keys, "feature", "n", "mean", "m2", "low", "high"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for key, columns in per_key_arrays(batch, keys, cols):
                own = held.setdefault(key, np.tile([0.0, 0.0, 0.0, np.inf, -np.inf], (len(cols), 1)))
                for t, v in zip(own, columns):
                    v = v[~np.isnan(v)]
                    if len(v):
                        n, mean = t[0] + len(v), v.mean()
                        t[2] += np.square(v - mean).sum() + (mean - t[1]) ** 2 * t[0] * len(v) / n
                        t[1] += (mean - t[1]) * len(v) / n
                        t[0], t[3], t[4] = n, min(t[3], v.min()), max(t[4], v.max())
            if len(held) > FLUSH:
                yield flushed()
                held = {}
        if held:
            yield flushed()

    return df.select(*keys, *cols).mapInArrow(run, fields + "feature string, n bigint, mean double, m2 double, low double, high double")


def collected(table: DataFrame, keys: Sequence[str], cols: Sequence[str], value: str) -> dict[tuple, list]:
    """A checked-size table of (keys, feature, numbers) as {key: numbers by column}."""
    at = {c: i for i, c in enumerate(cols)}
    out: dict[tuple, list] = {}
    for row in table.collect():
        out.setdefault(tuple(row[k] for k in keys), [None] * len(at))[at[row["feature"]]] = row[value]
    return out
