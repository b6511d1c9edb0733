"""Interval and distribution calibration from predictive samples (row keys, sample_id, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import as_col, equi
from barloom.functions.special import kolmogorov_p
from barloom.plans.quantiles import ranked_values
from barloom.session import cut_lineage

LEVELS = (0.5, 0.8, 0.9)
# Inner edges of ten equal bins on [0, 1] as doubles (note 0.30000000000000004).
PIT_EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def _tag(level: float) -> str:
    return f"{round(level * 100):d}"


def prediction_intervals(samples: DataFrame, row_keys: Sequence[str], levels: Sequence[float] = LEVELS) -> DataFrame:
    """Central intervals lower_NN / upper_NN per row; a row holds a fixed number of samples."""
    probs = [p for c in levels for p in ((1 - c) / 2, 1 - (1 - c) / 2)]
    q = samples.groupBy(*row_keys).agg(F.percentile("value", F.array(*[F.lit(p) for p in probs])).alias("_q"))
    cols = []
    for i, c in enumerate(levels):
        cols += [F.col("_q")[2 * i].alias(f"lower_{_tag(c)}"), F.col("_q")[2 * i + 1].alias(f"upper_{_tag(c)}")]
    return q.select(*row_keys, *cols)


def sample_summary(samples: DataFrame, actuals: DataFrame, row_keys: Sequence[str], levels: Sequence[float] = LEVELS) -> DataFrame:
    """Intervals, PIT and sample deviation per row in one aggregation, next to the actual."""
    probs = [p for c in levels for p in ((1 - c) / 2, 1 - (1 - c) / 2)]
    both = equi(samples, actuals.select(*row_keys, "actual"), list(row_keys))
    g = both.groupBy(*row_keys).agg(
        F.first("actual").alias("actual"),
        F.count(F.lit(1)).alias("n_samples"),
        F.percentile("value", F.array(*[F.lit(p) for p in probs])).alias("_q"),
        F.avg((F.col("value") <= F.col("actual")).cast("double")).alias("pit"),
        F.stddev_pop("value").alias("pred_std"),
    )
    cols = []
    for i, c in enumerate(levels):
        cols += [F.col("_q")[2 * i].alias(f"lower_{_tag(c)}"), F.col("_q")[2 * i + 1].alias(f"upper_{_tag(c)}")]
    return g.select(*row_keys, "actual", "n_samples", "pit", "pred_std", *cols)


def empirical_coverage(summary: DataFrame, by: Sequence[str], levels: Sequence[float] = LEVELS) -> DataFrame:
    """by..., nominal, empirical, gap - bounds are inclusive."""
    rows = F.array(
        *[
            F.struct(
                F.lit(float(c)).alias("nominal"),
                F.col("actual").between(F.col(f"lower_{_tag(c)}"), F.col(f"upper_{_tag(c)}")).cast("double").alias("_in"),
            )
            for c in levels
        ]
    )
    long = summary.select(*by, F.inline(rows))
    return long.groupBy(*by, "nominal").agg(F.avg("_in").alias("empirical")).withColumn(
        "gap", F.col("empirical") - F.col("nominal")
    )


def pit_values(samples: DataFrame, actuals: DataFrame, row_keys: Sequence[str]) -> DataFrame:
    both = equi(samples, actuals.select(*row_keys, "actual"), list(row_keys))
    return both.groupBy(*row_keys).agg(F.avg((F.col("value") <= F.col("actual")).cast("double")).alias("pit"))


def pit_bin(pit: Column | str) -> Column:
    """Bin 0..9 by comparison with the stored edges, so 0.3 falls in bin 2."""
    pit = as_col(pit)
    return sum(((pit >= F.lit(e)).cast("int") for e in PIT_EDGES), F.lit(0))


def pit_histogram(pits: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., bin, n for all ten bins, empty ones included."""
    counts = pits.groupBy(*by).agg(*[F.count_if(pit_bin("pit") == b).alias(f"_b{b}") for b in range(10)])
    rows = F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"_b{b}").alias("n")) for b in range(10)])
    return counts.select(*by, F.inline(rows))


def ks_uniform_statistic(pits: DataFrame, by: Sequence[str], value: str = "pit") -> DataFrame:
    """Largest gap between the empirical distribution and the uniform one, from exact distributed ranks."""
    n, x = F.col("total"), F.col("value")
    up = (F.col("last_rank") + 1) / n - x
    down = x - F.col("first_rank") / n
    return ranked_values(pits, by, value).groupBy(*by).agg(
        F.max("total").alias("n"), F.max(F.greatest(up, down)).alias("ks_statistic")
    )


def ks_uniform(pits: DataFrame, by: Sequence[str]) -> DataFrame:
    return ks_uniform_statistic(pits, by).withColumn("ks_pvalue", kolmogorov_p("ks_statistic", "n"))


def calibration_report(
    samples: DataFrame, actuals: DataFrame, row_keys: Sequence[str], by: Sequence[str], levels: Sequence[float] = LEVELS,
    with_p: bool = True,
) -> DataFrame:
    """One row per key: counts, coverage per level, PIT histogram, KS statistic, mean sample deviation."""
    rows = cut_lineage(sample_summary(samples, actuals, row_keys, levels))  # one row per forecast, read twice
    cover = [
        F.avg(F.col("actual").between(F.col(f"lower_{_tag(c)}"), F.col(f"upper_{_tag(c)}")).cast("double")).alias(
            f"coverage_{_tag(c)}"
        )
        for c in levels
    ]
    hist = F.array(*[F.count_if(pit_bin("pit") == b) for b in range(10)]).alias("pit_histogram")
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.max("n_samples").alias("n_samples"),
        *cover,
        hist,
        F.avg("pred_std").alias("pred_std_mean"),
    )
    ks = ks_uniform(rows, by) if with_p else ks_uniform_statistic(rows, by)
    return equi(base, ks.drop("n"), list(by))
