"""The walk-forward report: one row per key and fold, and one pooled row per key, over forecasts scored on the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import equi
from barloom.operators import calibration, drift, metrics, stats
from barloom.plans.panel import KEYS
from barloom.session import cut_lineage


def _both(part, keys: Sequence[str], fold: str, kind) -> DataFrame:
    """part(grouping columns) per fold and pooled, with a NULL fold for the pooled rows."""
    pooled = part(list(keys))
    return part([*keys, fold]).unionByName(pooled.withColumn(fold, F.lit(None).cast(kind)))


def _packed(df: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    return df.select(*on, F.struct(*[c for c in df.columns if c not in on]).alias(name))


def walk_forward_report(
    scored: DataFrame, models: Sequence[str], keys: Sequence[str] = KEYS, fold: str = "fold", alpha: str | None = None, samples: DataFrame | None = None,
    row_keys: Sequence[str] = (), boundaries: DataFrame | None = None, psi: DataFrame | None = None, orders: DataFrame | None = None,
) -> DataFrame:
    """keys, fold (NULL: pooled over folds) and, as structs: `metrics_<model>` of every model, `dm_vs_<model>` of the first
    one against the others, `direction` (its exact binomial test), `gate` (mean and deviation of `alpha`), `calibration` of
    its predictive `samples` (rows named by `row_keys`), `boundaries`, `psi` (counts, maximum, top features) and `order`.

    `scored` has the keys, fold, `actual` and one column per model; rows without a forecast of every model are left out, so
    that all are scored on identical rows. Parts that are not given are left out; boundaries, psi and orders are per fold.
    """
    keys, first = list(keys), models[0]
    on, kind = [*keys, fold], scored.schema[fold].dataType
    same = cut_lineage(scored.na.drop(subset=["actual", *models]))  # each part is one pass over it
    measured = metrics.metric_report(same.unpivot([*on, "actual"], list(models), "model", "pred"), [*keys, "model"], fold)
    values = [c for c in measured.columns if c not in (*on, "model")]
    out = measured.groupBy(*on).agg(*[F.max(F.when(F.col("model") == m, F.struct(*values))).alias(f"metrics_{m}") for m in models])

    def join(part: DataFrame, name: str) -> None:
        nonlocal out
        out = equi(out, _packed(part, on, name), on, "left")

    for other in models[1:]:
        join(_both(lambda by: stats.diebold_mariano(same, first, other, by), keys, fold, kind), f"dm_vs_{other}")  # noqa: B023
    join(_both(lambda by: stats.binomial_test(same.withColumn("pred", F.col(first)), by), keys, fold, kind), "direction")
    if alpha:
        join(_both(lambda by: same.groupBy(*by).agg(F.avg(alpha).alias("alpha_mean"), F.stddev_pop(alpha).alias("alpha_std")), keys, fold, kind), "gate")
    if samples is not None:
        actuals = same.select(*row_keys, "actual")
        join(_both(lambda by: calibration.calibration_report(samples, actuals, row_keys, by), keys, fold, kind), "calibration")
    if boundaries is not None:
        join(boundaries, "boundaries")
    if psi is not None:
        join(drift.psi_summary(psi, on), "psi")
    if orders is not None:
        join(orders, "order")
    return out
