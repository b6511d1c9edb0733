"""Window features of a bar panel. Every function here is a Catalyst expression over a window spec."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.columns import as_col, clip, finite_or_zero, ratio
from barloom.operators.joins import align_macro
from barloom.operators.recursive import add_indicators, signed_volume
from barloom.plans.panel import IDX, KEYS, row_index, running, windowed
from barloom.session import written

# The 39 feature names of the reference model input.
TECHNICAL = ("RSI", "MACD", "MACD_Signal", "MACD_Hist", "BB_Width", "ATR", "ADX", "MOM", "ROC", "OBV")
RETURNS = ("ret_1d", "ret_5d", "ret_10d", "ret_21d")
VOLATILITY = ("vol_5d", "vol_10d", "vol_21d")
SMA_RATIOS = ("sma10_ratio", "sma20_ratio", "sma50_ratio", "sma200_ratio")
SESSION = ("overnight_gap", "intraday_range", "close_position", "volume_ratio")
CALENDAR = ("dow", "month_frac", "is_month_end", "is_quarter_end")
MACRO_FEATURES = (
    "vix", "vix_change", "yield_10y", "yield_3m", "yield_change", "yield_spread", "dxy", "dxy_change", "gold_ret", "tlt_ret",
)
FEATURES = TECHNICAL + RETURNS + VOLATILITY + SMA_RATIOS + SESSION + CALENDAR + MACRO_FEATURES


def frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def only_full(value: Column, counted: Column | str, w: WindowSpec, n: int) -> Column:
    """NULL until the frame holds n non-null rows."""
    return F.when(F.count(as_col(counted)).over(frame(w, n)) == n, value)


def sma(c: Column | str, w: WindowSpec, n: int) -> Column:
    return F.avg(as_col(c)).over(frame(w, n))


def bollinger(c: Column | str, w: WindowSpec, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """(upper, middle, lower) with the sample deviation; NULL bands on the first row."""
    middle, dev = sma(c, w, n), F.stddev_samp(as_col(c)).over(frame(w, n))
    return middle + k * dev, middle, middle - k * dev


def bollinger_width(c: Column | str, w: WindowSpec, n: int = 20, k: float = 2.0) -> Column:
    upper, middle, lower = bollinger(c, w, n, k)
    return (upper - lower) / (middle + 1e-10)


def momentum(c: Column | str, w: WindowSpec, n: int = 10) -> Column:
    return as_col(c) - F.lag(as_col(c), n).over(w)


def pct_change(c: Column | str, w: WindowSpec, n: int = 1) -> Column:
    return ratio(c, F.lag(as_col(c), n).over(w)) - 1.0


def rate_of_change(c: Column | str, w: WindowSpec, n: int = 10) -> Column:
    return pct_change(c, w, n) * 100.0


def realised_vol(ret: Column | str, w: WindowSpec, n: int) -> Column:
    return only_full(F.stddev_samp(as_col(ret)).over(frame(w, n)), ret, w, n)


def sma_ratio(c: Column | str, w: WindowSpec, n: int) -> Column:
    return clip(ratio(c, only_full(sma(c, w, n), c, w, n)) - 1.0, -0.5, 0.5)


def overnight_gap(w: WindowSpec) -> Column:
    return clip(ratio("open", F.lag("close").over(w)) - 1.0, -0.1, 0.1)


def intraday_range() -> Column:
    return clip(ratio(F.col("high") - F.col("low"), "close"), 0.0, 0.2)


def close_position() -> Column:
    return F.coalesce(ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))


def volume_ratio(w: WindowSpec, n: int = 20) -> Column:
    return clip(ratio("volume", only_full(sma("volume", w, n), "volume", w, n)), 0.0, 10.0)


def calendar(d: str = "bar_date") -> dict[str, Column]:
    month_end = F.col(d) == F.last_day(d)
    return {
        "dow": F.weekday(d) / 4.0,
        "month_frac": (F.month(d) - 1) / 11.0,
        "is_month_end": month_end.cast("double"),
        "is_quarter_end": (month_end & (F.month(d) % 3 == 0)).cast("double"),
    }


def on_balance_volume(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    flow = windowed(df, lambda d, w: d.withColumn("_flow", signed_volume(w)), back=1, keys=keys)
    return running(flow, {"OBV": ("sum", "_flow")}, keys).drop("_flow")


def returns_target(w: WindowSpec, h: int = 1, clipped: bool = True) -> Column:
    """Forward return over h rows; the clipped form is the training target (0 where close <= 0)."""
    ahead = F.lead("close", h).over(w)
    raw = ratio(ahead, "close") - 1.0
    if not clipped:
        return raw
    return F.when(ahead.isNull(), None).when(F.col("close") <= 0, 0.0).otherwise(clip(raw, -0.2, 0.2))


def difference(c: Column | str, w: WindowSpec, k: int = 1) -> Column:
    """k-th difference for k in 0, 1, 2; NULL in the leading k rows."""
    c = as_col(c)
    if k == 0:
        return c
    if k == 1:
        return c - F.lag(c, 1).over(w)
    if k == 2:
        return c - 2.0 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)
    raise ValueError("difference supports k <= 2")


def inverse_difference(
    df: DataFrame, diff: str, level: Column | str, out: str = "level", slope: Column | str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Undo differencing: level_0 + running sum; with `slope` (the first difference at the origin), order 2."""
    if slope is None:
        return running(df, {"_acc": ("sum", diff)}, keys).withColumn(out, as_col(level) + F.col("_acc")).drop("_acc")
    first = running(df, {"_d1": ("sum", diff)}, keys).withColumn("_d1", as_col(slope) + F.col("_d1"))
    return running(first, {"_acc": ("sum", "_d1")}, keys).withColumn(out, as_col(level) + F.col("_acc")).drop("_d1", "_acc")


def moving_means(df: DataFrame, w: WindowSpec, specs: dict[str, tuple[str, int]], full: bool = True) -> DataFrame:
    """Moving averages name -> (column, n) by differencing running sums: constant work per row.

    A sliding frame re-adds its n rows for every row. The sums are of deviations from the chunk's first
    value, so they stay small and the difference keeps its digits. full=True needs n non-null rows.
    """
    cols = {c for c, _ in specs.values()}
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_base_{c}": F.first(c, True).over(run) for c in cols})
    df = df.withColumns({f"_sum_{c}": F.sum(F.col(c) - F.col(f"_base_{c}")).over(run) for c in cols})
    df = df.withColumns({f"_cnt_{c}": F.count(c).over(run) for c in cols})
    out = {}
    for name, (c, n) in specs.items():
        s = F.col(f"_sum_{c}") - F.coalesce(F.lag(f"_sum_{c}", n).over(w), F.lit(0.0))
        k = F.col(f"_cnt_{c}") - F.lag(f"_cnt_{c}", n, 0).over(w)
        out[name] = F.when(k == n if full else k > 0, F.col(f"_base_{c}") + s / F.nullif(k, F.lit(0)))
    return df.withColumns(out).drop(*[f"_{p}_{c}" for c in cols for p in ("base", "sum", "cnt")])


def price_features(df: DataFrame, w: WindowSpec) -> DataFrame:
    """All non-recursive bar features; reaches back 199 rows."""
    df = df.withColumns({f"ret_{n}d": pct_change("close", w, n) for n in (1, 5, 10, 21)})
    means = {f"_m{n}": ("close", n) for n in (10, 20, 50, 200)} | {"_mv": ("volume", 20)}
    df = moving_means(df, w, means)
    df = df.withColumns(
        {
            "BB_Width": bollinger_width("close", w),
            "MOM": momentum("close", w),
            "ROC": rate_of_change("close", w),
            **{f"vol_{n}d": realised_vol("ret_1d", w, n) for n in (5, 10, 21)},
            **{f"sma{n}_ratio": clip(ratio("close", f"_m{n}") - 1.0, -0.5, 0.5) for n in (10, 20, 50, 200)},
            "overnight_gap": overnight_gap(w),
            "intraday_range": intraday_range(),
            "close_position": close_position(),
            "volume_ratio": clip(ratio("volume", "_mv"), 0.0, 10.0),
            **calendar(),
        }
    )
    return df.drop(*means)


def macro_features(df: DataFrame, w: WindowSpec, names: Sequence[str]) -> DataFrame:
    """Features of the aligned macro columns that are present; reaches back one row."""
    have = set(names)
    cols: dict[str, Column] = {}
    if "VIX" in have:
        cols |= {"vix": F.col("VIX"), "vix_change": clip(pct_change("VIX", w), -1, 1)}
    if "TNX" in have:
        cols |= {"yield_10y": F.col("TNX"), "yield_change": clip(momentum("TNX", w, 1), -2, 2)}
        if "IRX" in have:
            cols |= {"yield_3m": F.col("IRX"), "yield_spread": clip(F.col("TNX") - F.col("IRX"), -5, 5)}
    if "DXY" in have:
        cols |= {"dxy": F.col("DXY"), "dxy_change": clip(pct_change("DXY", w), -0.1, 0.1)}
    if "GLD" in have:
        cols["gold_ret"] = clip(pct_change("GLD", w), -0.1, 0.1)
    if "TLT" in have:
        cols["tlt_ret"] = clip(pct_change("TLT", w), -0.1, 0.1)
    return df.withColumns(cols) if cols else df


def fill_forward_backward(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, order: Sequence[str] = (IDX,)
) -> DataFrame:
    """Forward fill, then fill the leading gap from the first later value."""
    specs = {f"_f_{c}": ("last", c) for c in cols} | {f"_b_{c}": ("next", c) for c in cols}
    out = running(df, specs, keys, order)
    return out.withColumns({c: F.coalesce(f"_f_{c}", f"_b_{c}") for c in cols}).drop(*specs)


INDICATOR_COLUMNS = (
    "RSI", "MACD", "MACD_Signal", "MACD_Hist", "BB_Upper", "BB_Middle", "BB_Lower", "BB_Width", "ATR", "ADX", "MOM", "ROC", "OBV",
)


def technical_indicators(df: DataFrame, keys: Sequence[str] = KEYS, size: int | None = None) -> DataFrame:
    """The 13 indicator columns at their default periods, next to the bars."""

    def native(d: DataFrame, w: WindowSpec) -> DataFrame:
        upper, middle, lower = bollinger("close", w)
        return d.withColumns(
            {
                "BB_Upper": upper, "BB_Middle": middle, "BB_Lower": lower, "BB_Width": bollinger_width("close", w),
                "MOM": momentum("close", w), "ROC": rate_of_change("close", w),
            }
        )

    return add_indicators(df, native, keys, size)


def engineer_features(
    bars: DataFrame,
    macro: DataFrame | None = None,
    warmup: str = "null",
    keys: Sequence[str] = KEYS,
    size: int | None = None,
) -> DataFrame:
    """keys, bar_date, row_idx, n_rows, close and the feature columns (39 with full macro).

    warmup="null" leaves rows without enough history NULL; warmup="bfill" fills every gap forward,
    then backward, then with zero, which lets warm-up rows see later values.
    """
    df = indexed = written(row_index(bars, keys, "bar_date", length="n_rows"))
    names: list[str] = []
    if macro is not None:
        names = [c for c in macro.columns if c != "obs_date"]
        df = align_macro(df, macro)

    def native(d: DataFrame, w: WindowSpec) -> DataFrame:
        return macro_features(price_features(d, w), w, names)

    df = add_indicators(df, native, keys, size, source=indexed)
    cols = [c for c in FEATURES if c in df.columns]
    df = df.select(*keys, "bar_date", IDX, "n_rows", "close", *cols)
    if warmup == "bfill":
        df = fill_forward_backward(df, cols, keys).withColumns({c: finite_or_zero(c) for c in cols})
    elif warmup != "null":
        raise ValueError("warmup is 'null' or 'bfill'")
    return df

