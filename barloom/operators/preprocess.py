"""End-to-end preprocessing: indicators, stationarity-driven differencing, filling, leakage-free scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import equi
from barloom.operators.econometrics import auto_difference
from barloom.operators.features import INDICATOR_COLUMNS, difference, fill_forward_backward, technical_indicators
from barloom.operators.folds import apply_scaler, chrono_split, fit_scaler
from barloom.plans.panel import IDX, KEYS, row_index, windowed
from barloom.session import cut_lineage


def preprocess_pipeline(
    bars: DataFrame, target: str = "close", keys: Sequence[str] = KEYS, max_order: int = 2
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(data, scaler, metadata): scaled columns per row, fitted parameters, and per series the
    differencing order, last target level and feature list. The scaler sees training rows only."""
    keys = list(keys)
    panel = cut_lineage(row_index(bars, keys, length="n_rows"))  # read by the tests and by the features
    orders = cut_lineage(auto_difference(panel, target, keys, max_order))
    wide = technical_indicators(panel, keys)
    steps = windowed(
        panel.select(*keys, IDX, target), lambda d, w: d.withColumns({f"_d{k}": difference(target, w, k) for k in range(max_order + 1)}), back=2, keys=keys
    )
    chosen = equi(steps, orders, keys).select(
        *keys, IDX, F.get(F.array(*[f"_d{k}" for k in range(max_order + 1)]), F.col("diff_order")).alias("target_diff")
    )
    cols = [*INDICATOR_COLUMNS, "target_diff"]
    data = cut_lineage(equi(wide, chosen, [*keys, IDX]).select(*keys, "bar_date", IDX, "n_rows", *cols))
    filled = chrono_split(fill_forward_backward(data, cols, keys))
    scaler = fit_scaler(filled.filter("split = 'train'"), cols, keys)
    scaled = apply_scaler(filled, scaler, cols, keys)
    last = panel.groupBy(*keys).agg(F.max_by(target, IDX).alias("last_target"))
    metadata = equi(orders, last, keys).withColumn("features", F.array(*[F.lit(c) for c in cols]))
    return scaled, scaler, metadata
