"""Chronological splits, walk-forward folds, samples and scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import as_col, clip, equi, finite_or_zero, ratio
from barloom.operators.clean import latest_rows, top_rows
from barloom.plans.attach import attach
from barloom.plans.panel import IDX, KEYS, windowed
from barloom.plans.wide import moments_pass

N_FOLDS, INITIAL, VALIDATION = 5, 0.55, 0.15
SEQUENCE = 60
VOL_INPUTS = ("ATR", "BB_Width", "ADX", "vol_21d", "intraday_range")


def chrono_split(df: DataFrame, train: float = 0.70, val: float = 0.85, n: str = "n_rows") -> DataFrame:
    cut = lambda share: F.floor(F.col(n) * F.lit(float(share)))
    return df.withColumn(
        "split",
        F.when(F.col(IDX) < cut(train), "train").when(F.col(IDX) < cut(val), "val").otherwise("test"),
    )


def fold_array(n: Column | str, k: int = N_FOLDS, initial: float = INITIAL, validation: float = VALIDATION) -> Column:
    """array<struct<fold, val_start, train_end, test_start, test_end>> for a series of n rows."""
    n = as_col(n)
    first = F.floor(n * F.lit(float(initial)))
    step = F.floor((n - first) / k)

    def one(i: int) -> Column:
        train_end = first + step * i
        test_end = n if i == k - 1 else train_end + step
        return F.struct(
            F.lit(i + 1).alias("fold"),
            F.floor(train_end * F.lit(1.0 - validation)).alias("val_start"),
            train_end.alias("train_end"),
            train_end.alias("test_start"),
            test_end.cast("long").alias("test_end"),
        )

    return F.array(*[one(i) for i in range(k)])


def fold_boundaries(df: DataFrame, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """One row per (series, fold) from the series lengths."""
    lengths = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return lengths.select(*keys, "n_rows", F.inline(fold_array("n_rows", **kw)))


def expand_folds(df: DataFrame, n: str = "n_rows", **kw) -> DataFrame:
    """Each row once per fold it belongs to, with its role and position in the test block.

    A projection plus explode on the row's own series length: no join, no shuffle.
    """
    f = F.explode(F.filter(fold_array(n, **kw), lambda x: F.col(IDX) < x["test_end"]))
    role = (
        F.when(F.col(IDX) < F.col("_f.val_start"), "train")
        .when(F.col(IDX) < F.col("_f.train_end"), "val")
        .otherwise("test")
    )
    return (
        df.withColumn("_f", f)
        .withColumns({"fold": F.col("_f.fold"), "role": role, "test_pos": F.col(IDX) - F.col("_f.test_start"),
                      "test_end": F.col("_f.test_end")})
        .drop("_f")
    )


def test_rows(df: DataFrame, drop_context: int = 0, n: str = "n_rows", **kw) -> DataFrame:
    """Scored test rows with their fold; test blocks are disjoint, so a row appears at most once.

    A block's first `drop_context` rows and its last row are not scored.
    """
    hit = F.filter(fold_array(n, **kw), lambda x: (F.col(IDX) >= x["test_start"]) & (F.col(IDX) < x["test_end"]))
    block = df.withColumn("_f", F.get(hit, F.lit(0))).filter("_f IS NOT NULL")
    block = block.withColumns(
        {"fold": F.col("_f.fold"), "test_pos": F.col(IDX) - F.col("_f.test_start"), "test_end": F.col("_f.test_end")}
    ).drop("_f")
    return block.filter((F.col("test_pos") >= drop_context) & (F.col(IDX) < F.col("test_end") - 1))


def scored_rows(folds: DataFrame, drop_context: int = 0) -> DataFrame:
    """Test rows that are scored: past the context and before the last row of their block."""
    return folds.filter(
        (F.col("role") == "test") & (F.col("test_pos") >= drop_context) & (F.col(IDX) < F.col("test_end") - 1)
    )


def sequence_windows(df: DataFrame, cols: Sequence[str], length: int = SEQUENCE, keys: Sequence[str] = KEYS) -> DataFrame:
    """`seq`: the feature rows t-length .. t-1 (row t excluded), for rows with a full window."""

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn("seq", F.collect_list(F.struct(*cols)).over(w.rowsBetween(-length, -1)))

    return windowed(df.filter(F.col(IDX).isNotNull()), build, back=length, keys=keys).filter(F.size("seq") == length)


def valid_samples(df: DataFrame, forecast: str = "ar_forecast", n: str = "n_rows", length: int = SEQUENCE) -> DataFrame:
    return df.filter(F.col(IDX).between(length, F.col(n) - 2) & F.col(forecast).isNotNull())


def vol_inputs(present: Sequence[str]) -> Column:
    """Five volatility inputs in [0, 1], 0.5 where missing; padded with the first feature."""
    names = [c for c in VOL_INPUTS if c in present]
    names = (names + [present[0]] * 5)[:5]
    return F.array(*[F.coalesce(clip(c, 0.0, 1.0), F.lit(0.5)) for c in names])


def ar_return_input(forecast: str = "ar_forecast", close: str = "close") -> Column:
    gap = clip(ratio(F.col(forecast) - F.col(close), close), -0.2, 0.2)
    return F.when(F.col(close) > 0, gap).otherwise(F.when(F.col(close).isNotNull(), 0.0))


def fit_scaler(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), kind: str = "standard") -> DataFrame:
    """Scaler table (by..., feature, mean, scale); fit it on training rows only.

    standard: population deviation, 1 where all values are equal. minmax: minimum and range, 1 where it is 0. Columns
    without a finite value have neither. One pass over wide rows; tasks hand on a few numbers per key and column.
    """
    by = list(by)
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    parts = moments_pass(rows, by, cols)
    # the rows of a key and column are as many as tasks: their own means weigh in against the common one
    w = Window.partitionBy(*by, "feature")
    parts = parts.withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    gap = F.col("mean") - F.col("_mean")
    if kind == "standard":
        # sums of equal values round: their mean is the value itself and their deviation 0
        same = F.min("low") == F.max("high")
        center = F.when(same, F.min("low")).otherwise(F.first("_mean"))
        spread = F.when(same, 0.0).otherwise(F.sqrt(F.sum(F.col("m2") + F.col("n") * gap * gap) / F.sum("n")))
    else:
        center, spread = F.min("low"), F.max("high") - F.min("low")
    fitted = parts.groupBy(*by, "feature").agg(center.alias("mean"), spread.alias("_spread"))
    return fitted.select(*by, "feature", "mean", F.coalesce(F.nullif(F.col("_spread"), F.lit(0.0)), F.lit(1.0)).alias("scale"))


def _params(scaler: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    picks = [
        F.max(F.when(F.col("feature") == c, F.struct("mean", "scale"))).alias(f"_p_{c}") for c in cols
    ]
    return scaler.groupBy(*by).agg(*picks) if by else scaler.agg(*picks)


def _with_params(df: DataFrame, scaler: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    by = list(by)
    if by:
        return attach(df, _params(scaler, cols, by), by, "left")
    one = _params(scaler, cols, by).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one", "left").drop("_one")


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Scale the columns with fitted parameters; one row of parameters per `by` key joins in."""
    out = _with_params(df, scaler, cols, by)
    scaled = {c: (F.col(c) - F.col(f"_p_{c}.mean")) / F.col(f"_p_{c}.scale") for c in cols}
    return out.withColumns(scaled).drop(*[f"_p_{c}" for c in cols])


def inverse_scale(df: DataFrame, scaler: DataFrame, feature: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    out = _with_params(df, scaler, [feature], by)
    return out.withColumn(value, F.col(value) * F.col(f"_p_{feature}.scale") + F.col(f"_p_{feature}.mean")).drop(
        f"_p_{feature}"
    )


def inverse_predictions(
    preds: DataFrame, scaler: DataFrame, feature: str, last_level: str, by: Sequence[str] = (), diff_order: int = 1,
    last_diff: str | None = None, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Unscale `pred`, then undo differencing of order 0, 1 or 2 from the last actual level."""
    from barloom.operators.features import inverse_difference

    out = inverse_scale(preds, scaler, feature, "pred", by)
    if diff_order == 0:
        return out.withColumn("level", F.col("pred"))
    return inverse_difference(out, "pred", last_level, "level", last_diff if diff_order == 2 else None, keys)


def period_slices(df: DataFrame, unit: str = "quarter", keys: Sequence[str] = KEYS, order: str = "bar_date") -> DataFrame:
    """Tag rows with their calendar period and whether the row is scored (not the last of its slice)."""
    df = df.withColumn("period", F.trunc(order, unit))
    last = df.groupBy(*keys, "period").agg(F.max(order).alias("_last"), F.count(F.lit(1)).alias("period_rows"))
    return equi(df, last, [*keys, "period"]).withColumn("scored", F.col(order) < F.col("_last")).drop("_last")


def model_inputs(rows: DataFrame, cols: Sequence[str], scaler: DataFrame, by: Sequence[str] = (), length: int = SEQUENCE, keys: Sequence[str] = KEYS) -> DataFrame:
    """A model's inputs per row with a full window: `seq`, the scaled feature rows t-length .. t-1 (0 where not finite), the
    row's own scaled volatilities in `vol_inputs`, and `ar_return`. Rows need `close` and `ar_forecast` besides the features.
    """
    scaled = apply_scaler(rows.withColumn("ar_return", ar_return_input()), scaler, cols, by)
    ready = scaled.withColumn("vol_inputs", vol_inputs(list(cols))).withColumns({c: finite_or_zero(c) for c in cols})
    return sequence_windows(ready, cols, length, keys)


def serving_inputs(features: DataFrame, cols: Sequence[str], scaler: DataFrame | None = None, by: Sequence[str] = (), length: int = SEQUENCE, keys: Sequence[str] = KEYS) -> DataFrame:
    """Model inputs of the newest row per series, built by the same functions as training rows.

    With a scaler these are all of `model_inputs`, from the newest length + 1 rows alone.
    """
    if scaler is None:
        rows = features.withColumns({"vol_inputs": vol_inputs(list(cols)), "ar_return": ar_return_input()})
        return latest_rows(rows, keys)
    last = top_rows(features, length + 1, F.col(IDX).desc(), keys)
    return latest_rows(model_inputs(last, cols, scaler, by, length, keys), keys)
