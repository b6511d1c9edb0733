"""Path-dependent indicators: linear recurrences cut into chunks.

An exponential average is y[t] = a y[t-1] + (1 - a) x[t], so what n rows do to it is the affine map y -> a^n y + b. Every
chunk's b is one weighted sum, added up map-side; a scan over one row per chunk composes the maps, and each chunk then
starts from the exact state before its first row. Nothing is forgotten, whatever a series' range of values. MACD's signal,
an average of a difference of averages, is linear in the same three states; RSI's averages and OBV's balance go along.

ADX averages an index that lies between 0 and 100 whatever came before; it starts SETTLE rows ahead of a chunk, after
which its own start weighs less than 1e-14.

`ema` skips missing values: such a row repeats the average before it. For `add_indicators` a row without a price repeats
the last one; a series that begins with such rows, or has more than the halo's in a row, has NULL averages from there on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.plans.attach import attach
from barloom.plans.panel import CHUNK, IDX, KEYS, MIN_CHUNK, chunk_size, handed_over, haloed, in_order, owned

RSI_PERIOD, MACD_SPANS, ATR_SPAN, ADX_SPAN = 14, (12, 26, 9), 14, 14
INDICATORS = ("RSI", "MACD", "MACD_Signal", "MACD_Hist", "ATR", "ADX", "OBV")


def decay(span: float) -> float:
    return (span - 1) / (span + 1)


SETTLE = math.ceil(math.log(1e-16) / math.log(decay(ADX_SPAN)))


def _ewm(x, span: float, start: float) -> np.ndarray:
    """The average after each value, from `start` before the first; unknown from an unknown start."""
    if math.isnan(start):
        return np.full(len(x), math.nan)
    return pd.Series(np.concatenate([[start], x])).ewm(span=span, adjust=False, ignore_na=True).mean().to_numpy()[1:]


def ema(df: DataFrame, c: str, span: int, out: str, keys: Sequence[str] = KEYS, size: int | None = None) -> DataFrame:
    """Exponential average of a column, started at its first value."""
    keys, size, a = list(keys), size or MIN_CHUNK, decay(span)
    cut = df.withColumn(CHUNK, F.expr(f"{IDX} div {size}"))
    after = F.count(c).over(Window.partitionBy(*keys, CHUNK).orderBy(F.col(IDX).desc()).rowsBetween(Window.unboundedPreceding, -1))
    weighed = cut.select(*keys, CHUNK, IDX, F.col(c).cast("double").alias("_x"), F.pow(F.lit(a), after).alias("_w"))
    totals = weighed.groupBy(*keys, CHUNK).agg(
        F.array(F.coalesce(F.sum((1 - a) * F.col("_w") * F.col("_x")), F.lit(0.0)), F.count("_x").cast("double"), F.coalesce(F.min_by("_x", F.when(F.col("_x").isNotNull(), F.col(IDX))), F.lit(0.0))).alias("totals")
    )

    def step(state, chunk):
        b, n, first = chunk
        before = state[0] if state is not None else math.nan
        return [before if n == 0 else a**n * (first if math.isnan(before) else before) + b]

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        state = pdf["_state"].iloc[0]
        before = pd.Series([math.nan if state is None else state[0]])  # unknown: the first value starts it
        pdf[out] = pd.concat([before, pdf[c].astype(float)]).ewm(span=span, adjust=False, ignore_na=True).mean().to_numpy()[1:]
        return pdf[names]

    return attach(cut, handed_over(totals, step, "_state", keys), [*keys, CHUNK]).groupBy(*keys, CHUNK).applyInPandas(run, schema)


def signed_volume(w) -> Column:
    """Volume with the sign of the close move; the first row counts in full."""
    step = F.signum(F.col("close") - F.lag("close").over(w))
    return F.when(F.col(IDX) == 0, F.col("volume")).otherwise(step * F.col("volume"))


#: What chunks hand over: MACD's fast, slow and signal averages, ATR's, the two directional ones, RSI's two, OBV's balance.
STATES = ("fast", "slow", "signal", "atr", "plus", "minus", "up", "down", "balance")


def _through(n: Column | int, slope: float, signal: float) -> Column | float:
    """How far a start of the fast (or slow) average reaches the signal after n rows."""
    power = (lambda x: F.pow(F.lit(x), n)) if isinstance(n, Column) else (lambda x: x**n)
    return (1 - signal) * slope * (power(signal) - power(slope)) / (signal - slope)


def chunk_totals(cut: DataFrame, size: int, back: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per chunk of `haloed(size, back + 1)` what its rows up to the next chunk's halo add to each state.

    The first row of a series also carries the states' start: its own price in the averages of price, its own range in
    ATR's, and RSI's seeds from the first period + 1 moves.
    """
    fast, slow, signal = map(decay, MACD_SPANS)
    smooth, wilder, period = decay(ATR_SPAN), (RSI_PERIOD - 1) / RSI_PERIOD, RSI_PERIOD
    w = Window.partitionBy(*keys, CHUNK).orderBy(IDX)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.when(F.col(IDX) == 0, F.col(c)))
    filled = {c: F.last(F.col(c).cast("double"), True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in ("high", "low", "close")}
    moves = cut.select(*keys, CHUNK, IDX, "volume", *[v.alias(c) for c, v in filled.items()]).select(
        *keys, CHUNK, IDX, F.col("close").alias("x"), (F.col("close") - before("close")).alias("d"),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before("close")), F.abs(F.col("low") - before("close"))).alias("tr"),
        (F.col("high") - before("high")).alias("rise"), (before("low") - F.col("low")).alias("fall"), signed_volume(w).alias("flow"),
    )
    end = (F.col(CHUNK) + 1) * size - back - 1
    mine = moves.filter(F.col(IDX).between(F.col(CHUNK) * size - back, end))
    left = end - F.col(IDX)
    power = lambda a, n=left: F.pow(F.lit(a), n)
    first = F.col(IDX) == 0
    start = lambda own, begun: F.when(first, own + begun).otherwise(own)
    average = lambda a: start((1 - a) * power(a), power(a, left + 1))
    # a price reaches the signal through both averages, and as the start of both
    reach = _through(left + 1, fast, signal) * (1 - fast) / fast - _through(left + 1, slow, signal) * (1 - slow) / slow
    reach = start(reach, _through(left + 1, fast, signal) - _through(left + 1, slow, signal))
    rsi = (F.when(F.col(IDX) >= period, power(wilder)).otherwise(0.0) + F.when(F.col(IDX).between(1, period + 1), power(wilder, end - (period - 1))).otherwise(0.0)) / period
    zero = F.lit(0.0)
    rise, fall, x, d = F.col("rise"), F.col("fall"), F.col("x"), F.col("d")
    plus, minus = F.when((rise > fall) & (rise > 0), rise).otherwise(zero), F.when((fall > rise) & (fall > 0), fall).otherwise(zero)
    parts = [average(fast) * x, average(slow) * x, reach * x, average(smooth) * F.col("tr"), (1 - smooth) * power(smooth) * plus, (1 - smooth) * power(smooth) * minus, rsi * F.greatest(d, zero), rsi * F.greatest(-d, zero), F.col("flow")]
    missing = F.col("x").isNull() | F.col("tr").isNull()
    sums = [F.sum(F.when(missing, F.lit(math.nan)).otherwise(p)) for p in parts[:-1]] + [F.sum("flow")]
    return mine.groupBy(*keys, CHUNK).agg(F.array(*[F.coalesce(s, zero) for s in sums]).alias("totals"))


def chunk_map(size: int) -> np.ndarray:
    """What `size` rows do to the states of `STATES`, besides adding their totals."""
    fast, slow, signal = map(decay, MACD_SPANS)
    smooth, wilder = decay(ATR_SPAN), (RSI_PERIOD - 1) / RSI_PERIOD
    out = np.diag([fast**size, slow**size, signal**size, *[smooth**size] * 3, wilder**size, wilder**size, 1.0])
    out[2, 0], out[2, 1] = _through(size, fast, signal), -_through(size, slow, signal)
    return out


def chunk_states(cut: DataFrame, size: int, back: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, chunk and `_state`: all states before the chunk's first halo row."""
    if size < back + 2 * RSI_PERIOD:
        raise ValueError("chunks must be longer than their halo and RSI's seeds")
    by = chunk_map(size)
    return handed_over(chunk_totals(cut, size, back, keys), lambda s, b: b if s is None else by @ s + b, "_state", keys)


def _rsi(delta: np.ndarray, first: bool, up0: float, down0: float, period: int) -> np.ndarray:
    """RSI after each move, from the averages before the first one; the first rows of a series seed their own."""
    n, start = len(delta), 0
    gain, loss = np.maximum(delta, 0.0), np.maximum(-delta, 0.0)
    if first:
        up0, down0 = gain[1 : period + 2].sum() / period, loss[1 : period + 2].sum() / period
        start = min(period, n)
    up, down = np.full(n, up0), np.full(n, down0)
    for acc, move, seed in ((up, gain, up0), (down, loss, down0)):
        acc[start:] = _ewm(move[start:], 2 * period - 1, seed)
    strength = np.divide(up, down, out=np.zeros(n), where=down != 0)
    return 100.0 - 100.0 / (1.0 + strength)


def add_indicators(
    df: DataFrame,
    native: Callable | None = None,
    keys: Sequence[str] = KEYS,
    size: int | None = None,
    which: Sequence[str] = INDICATORS,
    source: DataFrame | None = None,
) -> DataFrame:
    """RSI, MACD (3), ATR, ADX and OBV, after the optional window expressions of `native(frame, window)`.

    All steps share one exchange on (keys, chunk). The states come from a pass over the same bars; `source` may name a
    narrower frame of them.
    """
    keys = list(keys)
    back = max(SETTLE, 200)
    size = size or chunk_size(back + 1)
    cut = haloed(df, size, back + 1)
    w = Window.partitionBy(*keys, CHUNK).orderBy(IDX)
    work = native(cut, w) if native else cut
    payload = [f for f in work.schema.fields if f.name != CHUNK]
    bars = cut if source is None else haloed(source, size, back + 1)
    work = attach(work.withColumn("_owned", owned(size)), chunk_states(bars, size, back, keys), [*keys, CHUNK])
    schema = T.StructType([*payload, *[T.StructField(c, T.DoubleType()) for c in which]])
    names = schema.fieldNames()
    fast, slow, signal = MACD_SPANS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        mine = pdf["_owned"].to_numpy()
        if not mine.any():
            return pdf.reindex(columns=names).iloc[:0]
        high, low, close = (pdf[c].astype(float).ffill().to_numpy() for c in ("high", "low", "close"))
        volume = pdf["volume"].to_numpy(dtype=float)
        first = int(pdf[IDX].iloc[0]) == 0
        # the row before the halo only serves for moves
        skip = 0 if first else 1
        prev = np.concatenate([close[:1], close[:-1]])
        tr = np.maximum(high - low, np.maximum(np.abs(high - prev), np.abs(low - prev)))[skip:]
        rise, fall = np.diff(high, prepend=high[0])[skip:], -np.diff(low, prepend=low[0])[skip:]
        delta = (close - prev)[skip:]
        flow = np.nan_to_num(np.sign(delta) * volume[skip:])
        state = dict(zip(STATES, [close[0], close[0], 0.0, tr[0], 0.0, 0.0, 0.0, 0.0, 0.0] if first else pdf["_state"].iloc[0]))
        if first:
            flow[0] = np.nan_to_num(volume[0])
        close, mine = close[skip:], mine[skip:]
        macd = _ewm(close, fast, state["fast"]) - _ewm(close, slow, state["slow"])
        line = _ewm(macd, signal, state["signal"])
        plus = _ewm(np.where((rise > fall) & (rise > 0), rise, 0.0), ADX_SPAN, state["plus"])
        minus = _ewm(np.where((fall > rise) & (fall > 0), fall, 0.0), ADX_SPAN, state["minus"])
        index = 100.0 * np.abs(plus - minus) / (plus + minus + 1e-10)
        new = {
            "RSI": _rsi(delta, first, state["up"], state["down"], RSI_PERIOD), "MACD": macd, "MACD_Signal": line, "MACD_Hist": macd - line,
            "ATR": _ewm(tr, ATR_SPAN, state["atr"]), "ADX": _ewm(index, ADX_SPAN, index[0]), "OBV": state["balance"] + np.cumsum(flow),
        }
        return pdf.iloc[skip:].assign(**{c: new[c] for c in which}).loc[mine, names]

    return work.groupBy(*keys, CHUNK).applyInPandas(run, schema)
