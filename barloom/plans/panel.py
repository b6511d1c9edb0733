"""Skew-proof ordered computation over a panel.

A window partitioned by `series_id` alone puts a whole series into one task. Every ordered
operator here works on `(series, chunk)` pieces of bounded row count instead:

* `row_index`  - exact position of each row, from per-bucket counts and a prefix sum over buckets
* `haloed`     - copies the few rows a bounded frame needs into the neighbouring chunk
* `windowed`   - runs bounded-frame window expressions on haloed chunks
* `running`    - unbounded running sum / product / max / last as a two-level scan
* `handed_over`- a recurrence over one row per chunk, which gives every chunk the state it begins with

The result is identical to the one-partition-per-series window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import equi

KEYS = ("series_id",)
IDX = "row_idx"
CHUNK = "_chunk"
MIN_CHUNK = 2048


def chunk_size(halo: int) -> int:
    """Keep replicated halo rows at or below one eighth of the data."""
    return max(MIN_CHUNK, 8 * halo)


def _bucket(df: DataFrame, order: str) -> Column:
    """Coarse, order-preserving bucket whose row count is bounded when keys + order are unique."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(order) / 1024)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_date(F.to_date(order)).cast("long")
    return F.floor(F.col(order) / 65536)


def row_index(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str | Sequence[str] = "bar_date",
    out: str = IDX,
    length: str | None = None,
) -> DataFrame:
    """Zero-based row position per key (and the series length, if `length` names a column).

    `keys + order` must be unique. Only bucket counts are ever gathered per key.
    """
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    tagged = df.withColumn("_bucket", _bucket(df, order[0]))
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(
            F.sum("_n").over(by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        *([F.sum("_n").over(by_key).alias(length)] if length else []),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        equi(tagged, offsets, [*keys, "_bucket"])
        .withColumn(out, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def owned(size: int) -> Column:
    return F.expr(f"{IDX} div {size}") == F.col(CHUNK)


def haloed(df: DataFrame, size: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Tag rows with their chunk and copy boundary rows into the neighbour that needs them."""
    if max(back, ahead) > size:
        raise ValueError("halo longer than a chunk")
    home, pos = f"{IDX} div {size}", f"{IDX} % {size}"
    dest = [home]
    if back:
        dest.append(f"CASE WHEN {pos} >= {size - back} THEN {home} + 1 END")
    if ahead:
        dest.append(f"CASE WHEN {pos} < {ahead} AND {home} > 0 THEN {home} - 1 END")
    if len(dest) == 1:
        return df.withColumn(CHUNK, F.expr(home))
    return df.withColumn(CHUNK, F.explode(F.expr(f"array_compact(array({', '.join(dest)}))")))


def windowed(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    size: int | None = None,
) -> DataFrame:
    """Apply `build(frame, window)` on haloed chunks and keep each row once.

    `back` and `ahead` bound how many rows the expressions reach, summed over nesting.
    """
    size = size or chunk_size(max(back, ahead))
    w = Window.partitionBy(*keys, CHUNK).orderBy(IDX)
    return build(haloed(df, size, back, ahead), w).filter(owned(size)).drop(CHUNK)


def in_order(pdf, order: str = IDX):
    """The chunk by position; chunks coming straight from a window are sorted already."""
    return pdf if pdf[order].is_monotonic_increasing else pdf.sort_values(order, ignore_index=True)


def mapped(
    df: DataFrame,
    fn: Callable,
    schema: str | T.StructType,
    back: int,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    size: int | None = None,
) -> DataFrame:
    """Grouped-map over haloed chunks; `fn` gets the chunk sorted by position plus `_owned`."""
    size = size or chunk_size(max(back, ahead))
    cut = haloed(df, size, back, ahead).withColumn("_owned", owned(size))

    def run(pdf):
        return fn(in_order(pdf))

    return cut.groupBy(*keys, CHUNK).applyInPandas(run, schema)


def running(
    df: DataFrame,
    specs: Mapping[str, tuple[str, Column | str]],
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = (IDX,),
    size: int = 4 * MIN_CHUNK,
) -> DataFrame:
    """Unbounded running aggregates as a two-level scan.

    specs: output name -> (kind, column), kind in sum | product | max | min | last | next.
    `last` / `next` are the nearest non-null value at or before / at or after the row.
    Chunks are `size` positions of row_idx, or coarse buckets of the first order column. The input is
    read twice (rows, chunk totals); the totals branch reads only keys, order and summed columns.
    """
    keys, order = list(keys), list(order)
    first, here = Window.unboundedPreceding, Window.currentRow
    pieces = Window.partitionBy(*keys, CHUNK)
    # "next" scans run on the reversed order: a frame open towards the end is quadratic
    local = {False: pieces.orderBy(*order), True: pieces.orderBy(*[F.col(o).desc() for o in order])}
    by_key = Window.partitionBy(*keys)
    across = {False: by_key.orderBy(CHUNK), True: by_key.orderBy(F.col(CHUNK).desc())}
    fold = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}

    base = df.withColumn(CHUNK, F.expr(f"{IDX} div {size}") if order == [IDX] else _bucket(df, order[0]))
    base = base.withColumns({f"_v_{o}": c if isinstance(c, Column) else F.col(c) for o, (_, c) in specs.items()})
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    inner, total, carry, merge = {}, [], [], {}
    for out, (kind, _) in specs.items():
        v, t, back = F.col(f"_v_{out}"), f"_t_{out}", kind == "next"
        mine, prior = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if kind in fold:
            pick = lambda c: fold[kind](c)  # noqa: B023, E731
            total.append(fold[kind](v).alias(t))
        elif kind in ("last", "next"):
            pick = lambda c: F.last(c, True)
            total.append((F.min_by if back else F.max_by)(v, F.when(v.isNotNull(), at)).alias(t))
        else:
            raise ValueError(f"unknown running kind {kind!r}")
        inner[f"_l_{out}"] = pick(v).over(local[back].rowsBetween(first, here))
        carry.append(pick(F.col(t)).over(across[back].rowsBetween(first, -1)).alias(f"_c_{out}"))
        merge[out] = {
            "sum": F.coalesce(prior + mine, mine, prior) if kind == "sum" else None,
            "product": F.coalesce(prior * mine, mine, prior) if kind == "product" else None,
            "max": F.greatest(prior, mine) if kind == "max" else None,
            "min": F.least(prior, mine) if kind == "min" else None,
        }.get(kind, F.coalesce(mine, prior))
    carried = base.groupBy(*keys, CHUNK).agg(*total).select(*keys, CHUNK, *carry)
    scratch = [f"{p}{o}" for o in specs for p in ("_v_", "_l_", "_c_")]
    return equi(base.withColumns(inner), carried, [*keys, CHUNK]).withColumns(merge).drop(CHUNK, *scratch)


def handed_over(chunks: DataFrame, step: Callable, out: str, keys: Sequence[str] = KEYS, values: str = "totals") -> DataFrame:
    """keys, chunk and `out`, the state that earlier chunks hand over (NULL for a key's first chunk).

    `chunks` has one row per chunk with an array of numbers; step(state or None, numbers) gives the state after a chunk.
    A key's chunks are read in order and only one state is held, so a key of any length passes through one task as one
    small row per chunk.
    """
    keys = list(keys)
    kept = [chunks.schema[c] for c in (*keys, CHUNK)]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        last, state = None, None
        for b in batches:
            states = []
            for *key, numbers in zip(*[b.column(k).to_pylist() for k in keys], b.column(values).to_pylist()):
                if key != last:
                    last, state = key, None
                states.append(None if state is None else list(state))
                state = step(state, np.array(numbers, dtype=float))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(states, pa.list_(pa.float64()))], schema.fieldNames())

    placed = chunks.select(*keys, CHUNK, values).repartition(*keys).sortWithinPartitions(*keys, CHUNK)
    return placed.mapInArrow(run, schema)
