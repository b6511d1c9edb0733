"""Exact quantiles and rank scans of unbounded groups, without sorting a group in one task.

Equal values are first collapsed to counts (map-side), the distinct values are cut into ranges by
approximate splitters, and exact ranks come from range totals plus a scan inside each range.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import equi, finite
from barloom.plans.attach import attach, table_bytes
from barloom.plans.wide import MAX_BYTES, collected, count_pass
from barloom.session import cut_lineage

SPLITS = 64
ACCURACY = 5_000


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, splits: int = SPLITS) -> DataFrame:
    """keys, value, n, first_rank, last_rank (zero-based, inclusive), total - one row per distinct value."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value"))
    counts = cut_lineage(rows.agg(F.count(F.lit(1)).alias("n")))  # scanned by the splitters, totals and ranks
    cuts = [i / splits for i in range(1, splits)]
    # A splitter only shapes the ranges: its approximation never reaches the result.
    splitters = counts.groupBy(*keys).agg(
        F.percentile_approx("value", F.lit(cuts), F.lit(16 * splits)).alias("_cuts")
    )
    placed = attach(counts, splitters, keys).withColumn(
        "_range", F.expr("size(filter(_cuts, c -> c <= value))")
    ).drop("_cuts")
    by_key = Window.partitionBy(*keys)
    totals = (
        placed.groupBy(*keys, "_range")
        .agg(F.sum("n").alias("_m"))
        .select(
            *keys,
            "_range",
            F.coalesce(
                F.sum("_m").over(by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
            F.sum("_m").over(by_key).alias("total"),
        )
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        equi(placed, totals, [*keys, "_range"])
        .withColumn("last_rank", F.col("_before") + F.sum("n").over(inside) - 1)
        .withColumn("first_rank", F.col("last_rank") - F.col("n") + 1)
        .select(*keys, "value", "n", "first_rank", "last_rank", "total")
    )


def _grid(probs: Sequence[float], accuracy: int) -> list[float]:
    """Lower, then upper bracket positions of every wanted quantile, ascending."""
    eps = 2.0 / accuracy
    ps = sorted(probs)
    return [max(p - eps, 0.0) for p in ps] + [min(p + eps, 1.0) for p in ps]


def _brackets(total, cuts, k: int, accuracy: int) -> list:
    small = total <= 2 * accuracy  # a bounded group is one bracket
    lows = F.when(small, F.array(F.lit(-float("inf")))).otherwise(F.slice(cuts, 1, k))
    return [lows.alias("_los"), F.when(small, F.array(F.lit(float("inf")))).otherwise(F.slice(cuts, k + 1, k)).alias("_his")]


def count_below(edges: str, n: int, test) -> Column:
    """How many of the first n array elements pass `test`, as plain comparisons (array lambdas are not compiled)."""
    return sum((F.coalesce(test(F.get(edges, F.lit(i))).cast("int"), F.lit(0)) for i in range(n)), F.lit(0))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles", accuracy: int = ACCURACY
) -> DataFrame:
    """keys, `out` array<double>: linearly interpolated quantiles, exact for groups of any size.

    A mergeable sketch brackets every wanted rank; rows outside the brackets are only counted, rows
    inside (about 4 / accuracy of a large group per quantile) are ranked exactly. Reads `df` twice.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value"))
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.percentile_approx("value", F.lit(_grid(probs, accuracy)), F.lit(accuracy)).alias("_c")
    )
    sketch = sketch.select(*keys, "total", *_brackets(F.col("total"), F.col("_c"), len(probs), accuracy))
    return _ranked_quantiles(rows, sketch, keys, probs, out)


def feature_quantiles(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: Sequence[float], out: str = "quantiles", accuracy: int = ACCURACY
) -> DataFrame:
    """keys, feature, `out`: `exact_quantiles` of the finite values of many columns at once.

    The sketches are one aggregate per column over the few `keys`, so no row is repeated per feature for them.
    """
    keys, k = list(keys), len(probs)
    grid = F.lit(_grid(probs, accuracy))
    sketch = df.groupBy(*keys).agg(
        *[F.struct(F.count(finite(c)).alias("n"), F.percentile_approx(finite(c), grid, F.lit(accuracy)).alias("c")).alias(f"_s_{c}") for c in cols]
    )
    stacked = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_s_{c}.n").alias("total"), F.col(f"_s_{c}.c").alias("_c")) for c in cols])
    sketch = sketch.select(*keys, F.inline(stacked)).filter("total > 0")
    sketch = cut_lineage(sketch.select(*keys, "feature", "total", *_brackets(F.col("total"), F.col("_c"), k, accuracy)))
    if table_bytes(sketch) <= MAX_BYTES:
        packed = sketch.withColumn("_p", F.array(F.col("total").cast("double")))
        packed = packed.withColumn("_p", F.concat("_p", "_los", "_his"))
        # a bounded group has one bracket: its only lower bound stands for all
        split = lambda p: (p[1:2], p[2:]) if len(p) == 3 else (p[1 : 1 + k], p[1 + k :])
        places = {key: [None if p is None else tuple(map(np.asarray, split(p))) for p in row] for key, row in collected(packed, keys, cols, "_p").items()}

        def inside(v, j, p):
            return v >= np.append(p[0], np.inf)[np.minimum(j, len(p[0]))]

        counted = count_pass(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]), keys, cols, places, k + 1, lambda v, p: np.searchsorted(p[1], v, side="left"), inside)
        counts = counted.groupBy(*keys, "feature", "_j", "value").agg(F.sum("n").alias("n"))
        return _interpolated(attach(counts, sketch.select(*keys, "feature", "total"), [*keys, "feature"]), [*keys, "feature"], probs, out)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, list(cols), "feature", "value")
    rows = rows.withColumn("value", finite("value")).filter("value IS NOT NULL")
    return _ranked_quantiles(rows, sketch, [*keys, "feature"], probs, out)


def _ranked_quantiles(rows: DataFrame, sketch: DataFrame, keys: list[str], probs: Sequence[float], out: str) -> DataFrame:
    k = len(probs)
    placed = attach(rows, sketch, keys).withColumn("_j", count_below("_his", k, lambda h: h < F.col("value")))
    # rows below their bracket sort before it and need no value
    inside = F.when(F.col("value") >= F.coalesce(F.get("_los", F.col("_j")), F.lit(float("inf"))), F.col("value"))
    counts = placed.groupBy(*keys, "total", "_j", inside.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return _interpolated(counts, keys, probs, out)


def _interpolated(counts: DataFrame, keys: list[str], probs: Sequence[float], out: str) -> DataFrame:
    """Quantiles from rows per bracket: counts of rows before it (NULL value) and of each value inside."""
    k = len(probs)
    by_bracket = Window.partitionBy(*keys, "_j").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    # each row carries its place inside the bracket and the bracket's size so far; brackets per key are few
    counts = cut_lineage(counts)
    inner = counts.withColumn("_in", F.sum("n").over(by_bracket))
    sizes = counts.groupBy(*keys, "_j").agg(F.sum("n").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_j").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_j", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = equi(inner, offsets, [*keys, "_j"]).filter("value IS NOT NULL").withColumn("last_rank", F.col("_before") + F.col("_in") - 1)
    ranked = ranked.withColumn("first_rank", F.col("last_rank") - F.col("n") + 1)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    at = lambda r: (F.col("first_rank") <= r) & (F.col("last_rank") >= r)
    spot = lambda q: q["p"] * (F.col("total") - 1)
    hits = ranked.withColumn(
        "_q", F.explode(F.filter(wanted, lambda q: (F.col("first_rank") <= F.ceil(spot(q))) & (F.col("last_rank") >= F.floor(spot(q)))))
    ).withColumn("_rank", F.col("_q.p") * (F.col("total") - 1))
    ends = hits.groupBy(*keys, F.col("_q.i").alias("_i"), "_rank").agg(
        F.max(F.when(at(F.floor("_rank")), F.col("value"))).alias("_lo"),
        F.max(F.when(at(F.ceil("_rank")), F.col("value"))).alias("_hi"),
    )
    point = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - F.floor("_rank"))
    # at most len(probs) rows per key are gathered here
    found = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", point.alias("v")))).alias("_f"))
    whole = (F.size("_f") == k) & ~F.exists("_f", lambda s: s["v"].isNull())
    values = F.transform("_f", lambda s: s["v"])
    return found.select(*keys, F.when(whole, values).otherwise(F.raise_error(F.lit("a quantile fell outside its bracket"))).alias(out))
