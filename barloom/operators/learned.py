"""Learned return forecasters on Spark ML: per-fold regressions and bagged predictive samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.folds import N_FOLDS, apply_scaler, fit_scaler
from barloom.plans.attach import attach
from barloom.plans.moments import sum_arrays
from barloom.session import cut_lineage


def scaled_samples(folded: DataFrame, cols: Sequence[str], by: Sequence[str] = ("fold",)) -> DataFrame:
    """Rows with complete features and target, scaled by their fold's training rows."""
    rows = folded.na.drop(subset=[*cols, "actual"])
    return apply_scaler(rows, fit_scaler(rows.filter("role = 'train'"), cols, by), cols, by)


def ml_return_forecast(samples: DataFrame, cols: Sequence[str], kind: str = "linear", reg: float = 1e-3, n_folds: int = N_FOLDS) -> DataFrame:
    """Test-row forecasts per fold: one distributed model fit per fold on its training rows."""
    # every fold reads the samples again: write them once
    x = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(cut_lineage(samples))
    args = {"featuresCol": "_x", "labelCol": "actual", "predictionCol": "pred"}
    parts = []
    for k in range(1, n_folds + 1):  # a handful of folds; every fit is a distributed job
        est = LinearRegression(**args, regParam=reg) if kind == "linear" else GBTRegressor(**args, maxIter=10, maxDepth=3, seed=42)
        model = est.fit(x.filter((F.col("fold") == k) & (F.col("role") == "train")))
        parts.append(model.transform(x.filter((F.col("fold") == k) & (F.col("role") == "test"))))
    return reduce(DataFrame.unionByName, parts).drop("_x")


def bag_weights(row_keys: Sequence[str], n_samples: int, seed: int) -> Column:
    """How often each member's bootstrap draws a row: Poisson(1) counts derived from a hash of the row, so a repeated or
    recomputed task draws the same."""
    # by inversion, up to the first value that the largest u cannot pass
    cdf, total, term = [], 0.0, np.exp(-1.0)
    while total <= 1_000_002.5 / 1_000_003.0:
        total += term
        cdf.append(total)
        term /= len(cdf)

    def weight(i: Column) -> Column:
        u = (F.pmod(F.xxhash64(F.lit(seed), i, *row_keys), F.lit(1_000_003)) + 0.5) / 1_000_003.0
        return F.size(F.filter(F.array(*map(F.lit, cdf)), lambda c: u >= c)).cast("double")

    return F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), weight)


def bagged_samples(
    samples: DataFrame, cols: Sequence[str], row_keys: Sequence[str], n_samples: int = 30, ridge: float = 1.0, seed: int = 42, by: str = "fold"
) -> DataFrame:
    """row_keys, sample_id, value: predictions of bootstrap-weighted ridge members per fold.

    One pass over the training rows: every partition adds up the weighted cross-products of all members with one matrix
    product a batch, and hands on one row per fold and member; one small solve per member follows.
    """
    k = len(cols) + 1
    samples = cut_lineage(samples)  # read for training and for scoring
    v = F.array(F.lit(1.0), *cols)
    train = samples.filter("role = 'train'").select(by, v.alias("v"), F.col("actual").cast("double").alias("y"), bag_weights(row_keys, n_samples, seed).alias("w"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def handed() -> pa.RecordBatch:
            keys = pa.array([key for key in sums for _ in range(n_samples)], kind)
            rows = pa.array([row for total in sums.values() for row in total.tolist()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([keys, pa.array(list(range(n_samples)) * len(sums), pa.int32()), rows], [by, "sample_id", "s"])

        for b in batches:
            kind = b.column(by).type
            x, y, w = (np.asarray(b.column(c).flatten() if c != "y" else b.column(c), dtype=float).reshape(b.num_rows, -1) for c in ("v", "y", "w"))
            products = np.concatenate([(x[:, :, None] * x[:, None, :]).reshape(len(x), -1), x * y], axis=1)
            own = b.column(by).to_pylist()
            for key in dict.fromkeys(own):
                pick = np.array([o == key for o in own])
                sums[key] = sums.get(key, 0.0) + w[pick].T @ products[pick]
            if len(sums) > 256:
                yield handed()
                sums.clear()
        if sums:
            yield handed()

    schema = T.StructType([train.schema[by], T.StructField("sample_id", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
    totals = sum_arrays(train.mapInArrow(add, schema), [by, "sample_id"], "s")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(s: pd.Series) -> pd.Series:
        out = []
        for flat in s:
            flat = np.asarray(flat, dtype=float)
            g = flat[: k * k].reshape(k, k) + ridge * np.diag([0.0] + [1.0] * (k - 1))
            out.append(np.linalg.solve(g, flat[k * k :]))
        return pd.Series(out)

    members = totals.select(by, "sample_id", solve("s").alias("beta"))
    packed = members.groupBy(by).agg(F.collect_list(F.struct("sample_id", "beta")).alias("_members"))  # n_samples entries
    scored = attach(samples.filter("role = 'test'"), packed, [by])
    each = scored.select(*dict.fromkeys([by, *row_keys]), v.alias("v"), "actual", F.inline("_members"))
    dot = F.aggregate(F.zip_with("v", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return each.select(*dict.fromkeys([by, *row_keys]), "sample_id", dot.alias("value"), "actual")
