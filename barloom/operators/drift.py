"""Population stability of features between a reference and a current window."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import finite
from barloom.plans.attach import attach, table_bytes
from barloom.plans.quantiles import ACCURACY, count_below, exact_quantiles, feature_quantiles
from barloom.plans.wide import MAX_BYTES, collected, count_pass
from barloom.session import cut_lineage

BUCKETS, EPSILON, ALERT, MODERATE = 10, 1e-4, 0.25, 0.10


def long_features(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """ids..., feature, value - finite values only; columns absent from the frame are skipped."""
    have = [c for c in cols if c in df.columns]
    return df.unpivot(list(ids), have, "feature", "value").withColumn("value", finite("value")).filter("value IS NOT NULL")


def psi_edges(reference: DataFrame, by: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """by..., inner_edges: unique quantile edges of the reference without the outer pair.

    Fewer than three unique edges leave the two extremes as inner edges.
    """
    return _inner_edges(exact_quantiles(reference, by, "value", _deciles(buckets), "_q"), by)


def _deciles(buckets: int) -> list[float]:
    return [i / buckets for i in range(buckets + 1)]


def _inner_edges(q: DataFrame, by: Sequence[str]) -> DataFrame:
    q = q.withColumn("_e", F.array_distinct("_q"))
    wide = F.slice("_e", F.lit(2), F.size("_e") - 2)
    narrow = F.array(F.array_min("_q"), F.array_max("_q"))
    return q.select(*by, F.when(F.size("_e") >= 3, wide).otherwise(narrow).alias("inner_edges"))


def bucket_of(value: str = "value", edges: str = "inner_edges", buckets: int = BUCKETS) -> Column:
    return count_below(edges, buckets - 1, lambda e: e <= F.col(value))


def bucket_counts(long: DataFrame, edges: DataFrame, by: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """by..., is_reference, bucket, n - `long` carries the boolean is_reference."""
    return (
        attach(long, edges, by)
        .groupBy(*by, "is_reference", bucket_of(buckets=max(buckets, 3)).alias("bucket"), F.size("inner_edges").alias("last_bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def psi_from_counts(counts: DataFrame, by: Sequence[str], epsilon: float = EPSILON) -> DataFrame:
    """PSI per key from bucket counts; missing buckets count as zero, an empty side gives NULL."""
    by = list(by)
    sides = counts.groupBy(*by, "last_bucket", "bucket").agg(
        F.coalesce(F.sum(F.when(F.col("is_reference"), F.col("n"))), F.lit(0)).alias("_r"),
        F.coalesce(F.sum(F.when(~F.col("is_reference"), F.col("n"))), F.lit(0)).alias("_c"),
    )
    w = Window.partitionBy(*by)  # at most one row per bucket
    filled = sides.groupBy(*by, "last_bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("_r", "_c")))).alias("_m")
    )
    zero = F.struct(F.lit(0).cast("long").alias("_r"), F.lit(0).cast("long").alias("_c"))
    rows = filled.select(
        *by, "_m", F.explode(F.sequence(F.lit(0), F.col("last_bucket"))).alias("bucket")
    ).withColumn("_s", F.coalesce(F.try_element_at("_m", F.col("bucket")), zero))
    share = lambda c: F.greatest(F.try_divide(c, F.sum(c).over(w)), F.lit(epsilon))
    rows = rows.withColumns({"_nr": F.sum("_s._r").over(w), "_nc": F.sum("_s._c").over(w)}).filter("_nr > 0")
    rows = rows.withColumns({"_p": share(F.col("_s._r")), "_q": F.when(F.col("_nc") > 0, share(F.col("_s._c")))})
    rows = rows.withColumns({"_p": F.col("_p") / F.sum("_p").over(w), "_q": F.col("_q") / F.sum("_q").over(w)})
    term = (F.col("_q") - F.col("_p")) * F.ln(F.col("_q") / F.col("_p"))
    return rows.groupBy(*by).agg(
        F.sum(term).alias("psi"),
        F.max("_nr").alias("n_reference"),
        F.max("_nc").alias("n_current"),
        F.count(F.lit(1)).alias("n_buckets"),
        (F.count_if(F.col("_s._c") > 0) == 1).alias("is_saturated"),
    )


def psi(long: DataFrame, by: Sequence[str], buckets: int = BUCKETS, epsilon: float = EPSILON, edges: DataFrame | None = None) -> DataFrame:
    """`long`: by..., value, is_reference. Edges come from the reference side unless given.

    `long` is read three times (sketch, ranks, bucket counts): unpivot it from a written feature table.
    """
    if edges is None:
        edges = psi_edges(long.filter("is_reference"), by, buckets)
    return psi_from_counts(bucket_counts(long, edges, by, buckets), by, epsilon)


def psi_features(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], buckets: int = BUCKETS, epsilon: float = EPSILON, accuracy: int = ACCURACY
) -> DataFrame:
    """PSI per key and feature of a wide table with the boolean is_reference; absent columns are skipped.

    `df` is read three times (sketch, ranks, bucket counts): derive it cheaply from a written feature table.
    """
    by, have = list(by), [c for c in cols if c in df.columns]
    slim = df.select(*by, "is_reference", *have)
    q = feature_quantiles(slim.filter("is_reference"), by, have, _deciles(buckets), "_q", accuracy)
    key = [*by, "feature"]
    edges = cut_lineage(_inner_edges(q, key))
    if table_bytes(edges) <= MAX_BYTES:
        counts = _wide_counts(slim, by, have, edges, max(buckets, 3))
    else:
        counts = bucket_counts(long_features(slim, [*by, "is_reference"], have), edges, key, buckets)
    return psi_from_counts(counts, key, epsilon)


def _wide_counts(df: DataFrame, by: list[str], cols: Sequence[str], edges: DataFrame, buckets: int) -> DataFrame:
    """`bucket_counts` of all columns in one pass over wide rows, for an edge table of checked size."""
    found = collected(edges, by, cols, "inner_edges")
    numbers = {key: [None if e is None else np.asarray(e) for e in row] for key, row in found.items()}
    both = {(*key, side): row for key, row in numbers.items() for side in (True, False)}
    keys = [*by, "is_reference"]
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    counted = count_pass(wide, keys, cols, both, buckets, lambda v, e: np.searchsorted(e, v, side="right"))
    counts = counted.groupBy(*keys, "feature", F.col("_j").alias("bucket")).agg(F.sum("n").alias("n"))
    last = edges.select(*by, "feature", F.size("inner_edges").alias("last_bucket"))
    return attach(counts, last, [*by, "feature"])


def with_status(df: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("psi").isNull(), "unknown")
        .when(F.col("psi") >= ALERT, "alert")
        .when(F.col("psi") >= MODERATE, "moderate_drift")
        .otherwise("stable")
    )
    return df.withColumn("status", status)


def psi_report(long: DataFrame, by: Sequence[str], **kw) -> DataFrame:
    """PSI with status, highest first within each leading key."""
    return ranked_report(psi(long, by, **kw), by)


def ranked_report(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    *lead, feature = by
    return with_status(scores).orderBy(*lead, F.col("psi").desc_nulls_last(), feature)


def psi_summary(report: DataFrame, by: Sequence[str], top: int = 5) -> DataFrame:
    """Alert and moderate counts, maximum and the top features per key (features are few per key)."""
    w = Window.partitionBy(*by).orderBy(F.col("psi").desc_nulls_last(), F.col("feature"))
    ranked = report.withColumn("_rank", F.row_number().over(w))
    best = F.collect_list(F.when(F.col("_rank") <= top, F.struct("_rank", "feature")))
    return ranked.groupBy(*by).agg(
        F.count_if(F.col("status") == "alert").alias("n_alert"),
        F.count_if(F.col("status") == "moderate_drift").alias("n_moderate"),
        F.max("psi").alias("psi_max"),
        F.transform(F.sort_array(best), lambda s: s["feature"]).alias("top_features"),
    )
