"""Forecast combination, gating and signals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import as_col, equi
from barloom.operators.folds import N_FOLDS
from barloom.session import cut_lineage

DEAD_BAND = 0.002


def persistence() -> Column:
    return F.lit(0.0)


def sign_persistence(w, ret: str = "ret_1d") -> Column:
    """Sign of the previous return."""
    return F.signum(F.lag(ret).over(w))


def gated_blend(alpha: Column | str, first: Column | str, second: Column | str) -> Column:
    a = as_col(alpha)
    return a * as_col(first) + (1.0 - a) * as_col(second)


def fit_gate(train: DataFrame, inputs: Sequence[str], first: str, second: str, reg: float = 1e-3):
    """Gate model: probability that the first forecast is the closer one, from the gate inputs."""
    better = (F.abs(F.col(first) - F.col("actual")) < F.abs(F.col(second) - F.col("actual"))).cast("double")
    rows = VectorAssembler(inputCols=list(inputs), outputCol="_x").transform(train.withColumn("_better", better).na.drop(subset=list(inputs)))
    return LogisticRegression(featuresCol="_x", labelCol="_better", regParam=reg, probabilityCol="_prob").fit(rows)


def apply_gate(model, df: DataFrame, inputs: Sequence[str], first: str, second: str) -> DataFrame:
    """`alpha` and the blended `pred`; rows with a missing gate input get an even blend."""
    filled = df.withColumns({f"_g_{c}": F.coalesce(F.col(c), F.lit(0.0)) for c in inputs})
    x = VectorAssembler(inputCols=[f"_g_{c}" for c in inputs], outputCol="_x").transform(filled)
    complete = F.lit(True)
    for c in inputs:
        complete = complete & F.col(c).isNotNull()
    out = model.transform(x).withColumn("alpha", F.when(complete, vector_to_array("_prob")[1]).otherwise(0.5))
    return out.withColumn("pred", gated_blend("alpha", first, second)).select(*df.columns, "alpha", "pred")


def fold_gates(rows: DataFrame, inputs: Sequence[str], first: str, second: str, n_folds: int = N_FOLDS) -> DataFrame:
    """Test rows of every fold, blended by a gate fitted on that fold's own validation rows.

    A row that is in the test part of one fold may be in the validation part of a later one, so folds never
    share a gate. A fold whose validation rows all prefer one forecast gets that forecast; without any, an even blend.
    """
    rows = cut_lineage(rows)
    parts = []
    for k in range(1, n_folds + 1):  # a handful of folds; every fit is a distributed job
        own = rows.filter(F.col("fold") == k)
        val, test = own.filter("role = 'val'"), own.filter("role = 'test'")
        better = val.na.drop(subset=[*inputs, first, second, "actual"]).agg(F.avg((F.abs(F.col(first) - F.col("actual")) < F.abs(F.col(second) - F.col("actual"))).cast("double"))).first()[0]
        if better is None or better in (0.0, 1.0):
            alpha = F.lit(0.5 if better is None else better)
            parts.append(test.withColumn("alpha", alpha).withColumn("pred", gated_blend("alpha", first, second)))
        else:
            parts.append(apply_gate(fit_gate(val, inputs, first, second), test, inputs, first, second))
    return reduce(DataFrame.unionByName, parts)


def select_primary(preferred: str, fallback: str, preferred_name: str, fallback_name: str) -> tuple[Column, Column]:
    """(forecast, model name): the configured model when it has a forecast, else the other one."""
    value = F.coalesce(F.col(preferred), F.col(fallback))
    name = F.when(F.col(preferred).isNotNull(), preferred_name).when(F.col(fallback).isNotNull(), fallback_name)
    return value, name


def signal_label(ret: Column | str, band: float = DEAD_BAND) -> Column:
    r = as_col(ret)
    return F.when(F.abs(r) < band, "HOLD").when(r > 0, "BUY").when(r.isNotNull(), "SELL")


def predicted_price(close: Column | str, ret: Column | str) -> Column:
    return as_col(close) * (1.0 + as_col(ret))


def forecast_response(
    latest: DataFrame, recent: DataFrame | None = None, keys: Sequence[str] = ("series_id",), orders: DataFrame | None = None, provenance: DataFrame | None = None,
    version: str | None = None,
) -> DataFrame:
    """One row per series: price, return in percent, signal, both forecasts and the next session.

    `latest` holds close, bar_date, arima_return, hybrid_return and alpha of the newest row. `orders` (keys, p, q, of
    returns) adds `arima_order`, NULL where the first model gave no forecast; `provenance`, the one row of
    `snapshot_provenance`, adds where the data came from; `version` names the stored model.
    """
    from barloom.operators.clean import next_session

    value, name = select_primary("arima_return", "hybrid_return", "arima", "hybrid")
    out = latest.withColumns({"_r": value, "model": name})
    out = out.select(
        *keys,
        F.col("bar_date").alias("as_of"),
        next_session("bar_date").alias("forecast_for"),
        F.round("close", 2).alias("last_close"),
        F.round(predicted_price("close", "_r"), 2).alias("predicted_price"),
        F.round(F.col("_r") * 100.0, 4).alias("predicted_return_pct"),
        signal_label("_r").alias("signal"),
        "model",
        "alpha",
        "arima_return",
        "hybrid_return",
    )
    if orders is not None:
        order = orders.select(*keys, F.array(F.col("p").cast("int"), F.lit(0), F.col("q").cast("int")).alias("arima_order"))
        out = equi(out, order, list(keys), "left").withColumn("arima_order", F.when(F.col("arima_return").isNotNull(), F.col("arima_order")))
    if provenance is not None:
        origin = provenance.select(F.lit(1).alias("_one"), F.col("source").alias("data_source"), F.col("live_rows").alias("live_rows_appended"), F.col("note").alias("data_note"))
        out = out.withColumn("_one", F.lit(1)).join(F.broadcast(origin), "_one", "left").drop("_one")
    if version is not None:
        out = out.withColumn("model_version", F.lit(version))
    return equi(out, recent, list(keys), "left") if recent is not None else out
