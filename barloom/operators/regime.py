"""Gaussian hidden-Markov regimes: fit, causal filter, smoothing and the best path.

The forward recursion is a product of K x K matrices, which is associative. A long series is cut into
chunks: each chunk reports the product of its matrices, a pass over the (few) chunk rows hands every
chunk its incoming state, and chunks then run independently. Smoothing and the best path work the
same way, the latter with max in place of sum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import equi
from barloom.operators.folds import expand_folds
from barloom.plans.attach import attach
from barloom.plans.panel import CHUNK, IDX, KEYS, in_order
from barloom.session import cut_lineage, discard, written

N_STATES, N_ITER, TOL = 2, 200, 1e-3
CHUNK_ROWS = 65_536
FIT_ROWS = 262_144  # rows x (8 bytes per column) a single fit task may hold; beyond, the same fit in chunks
VAR_FLOOR = 1e-4  # share of the column's own variance
_A = T.ArrayType(T.DoubleType())
PARAM_FIELDS = [T.StructField("start", _A), T.StructField("trans", _A), T.StructField("means", _A), T.StructField("vars", _A)]
STAT_FIELDS = [T.StructField("log_likelihood", T.DoubleType()), T.StructField("iterations", T.IntegerType()), T.StructField("n_rows", T.LongType())]


class Params:
    def __init__(self, start, trans, means, variances):
        self.start = np.asarray(start, dtype=float)
        k = len(self.start)
        self.trans = np.asarray(trans, dtype=float).reshape(k, k)
        self.means = np.asarray(means, dtype=float).reshape(k, -1)
        self.vars = np.asarray(variances, dtype=float).reshape(k, -1)

    def flat(self) -> list:
        return [self.start, self.trans.ravel(), self.means.ravel(), self.vars.ravel()]


def log_emission(x: np.ndarray, p: Params) -> np.ndarray:
    gap = x[:, None, :] - p.means[None]
    return -0.5 * np.sum(np.log(2 * np.pi * p.vars)[None] + gap * gap / p.vars[None], axis=2)


def step_matrices(x: np.ndarray, p: Params, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per-row matrices M with alpha_t = alpha_{t-1} M_t (each scaled) and the log scales taken out.

    For the first row of a series M ignores the incoming state and applies the start distribution.
    """
    logb = log_emission(x, p)
    top = logb.max(axis=1, keepdims=True)
    b = np.exp(logb - top)
    m = (p.trans + 1e-300)[None] * b[:, None, :]
    if first:
        m[0] = np.tile((p.start + 1e-300) * b[0], (len(p.start), 1))
    return m, top[:, 0]


def _blocks(m: np.ndarray) -> tuple[np.ndarray, int]:
    """Reshape (n, K, K) to (blocks, width, K, K), padded with identities."""
    n, k = len(m), m.shape[1]
    width = max(int(np.sqrt(n)), 1)
    pad = -n % width
    if pad:
        m = np.concatenate([m, np.tile(np.eye(k), (pad, 1, 1))])
    return m.reshape(-1, width, k, k), n


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(v.sum(axis=tuple(range(1, v.ndim)), keepdims=True), 1e-300)


def product(m: np.ndarray) -> np.ndarray:
    """Scaled product of all matrices."""
    blocks, _ = _blocks(m)
    acc = blocks[:, 0]
    for i in range(1, blocks.shape[1]):
        acc = _unit(acc @ blocks[:, i])
    total = acc[0]
    for b in acc[1:]:
        total = total @ b
        total = total / max(total.sum(), 1e-300)
    return total


def forward(alpha: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Normalised alpha for every row, blocks side by side."""
    blocks, n = _blocks(m)
    count, width, k, _ = blocks.shape
    acc = blocks[:, 0]
    for i in range(1, width):
        acc = _unit(acc @ blocks[:, i])
    starts = np.empty((count, k))
    for b in range(count):
        starts[b] = alpha
        alpha = alpha @ acc[b]
        alpha = alpha / max(alpha.sum(), 1e-300)
    out = np.empty((count, width, k))
    state = starts
    for i in range(width):
        state = _unit(np.einsum("bk,bkj->bj", state, blocks[:, i]))
        out[:, i] = state
    return out.reshape(-1, k)[:n]


def backward(beta: np.ndarray, m: np.ndarray) -> np.ndarray:
    """beta_t for every row given beta after the last one: beta_t = M_{t+1} beta_{t+1}."""
    shifted = np.concatenate([m[1:], np.eye(m.shape[1])[None]])
    flipped = np.transpose(shifted[::-1], (0, 2, 1))
    return forward(beta, flipped)[::-1]


# --- fitting
def _initial(x: np.ndarray, k: int) -> Params:
    """States split by the size of the first column's deviation from its mean."""
    size = np.abs(x[:, 0] - x[:, 0].mean())
    cuts = np.quantile(size, np.arange(1, k) / k)
    group = np.searchsorted(cuts, size, side="right")
    floor = VAR_FLOOR * np.maximum(x.var(axis=0), 1e-300)
    means = np.stack([x[group == s].mean(axis=0) if (group == s).any() else x.mean(axis=0) for s in range(k)])
    variances = np.stack([np.maximum(x[group == s].var(axis=0) if (group == s).any() else x.var(axis=0), floor) for s in range(k)])
    trans = np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))
    return Params(np.full(k, 1.0 / k), trans, means, variances)


def _expect(x: np.ndarray, p: Params, alpha_in: np.ndarray, beta_out: np.ndarray, first: bool) -> np.ndarray:
    """Flat sufficient statistics of one piece: state weights, sums, squares, transitions, likelihood, first row."""
    m, top = step_matrices(x, p, first)
    alpha, beta = forward(alpha_in, m), backward(beta_out, m)
    gamma = _unit(alpha * beta)
    before = np.concatenate([alpha_in[None], alpha[:-1]])
    scale = np.einsum("tk,tkj->t", before, m)
    xi = before[:, :, None] * m * beta[:, None, :]
    xi = xi / np.maximum(xi.sum(axis=(1, 2), keepdims=True), 1e-300)
    if first:
        xi[0] = 0.0
        scale[0] = m[0, 0].sum()
    start = gamma[0] if first else np.zeros(len(p.start))
    llf = float(np.sum(np.log(np.maximum(scale, 1e-300)) + top))
    return np.concatenate([gamma.sum(axis=0), (gamma.T @ x).ravel(), (gamma.T @ (x * x)).ravel(), xi.sum(axis=0).ravel(), start, [llf, len(x)]])


def _maximise(stats: np.ndarray, k: int, d: int, floor: np.ndarray) -> tuple[Params, float]:
    cuts = np.cumsum([k, k * d, k * d, k * k, k])
    weight, s1, s2, xi, start = (np.asarray(a) for a in np.split(stats[:-2], cuts)[:5])
    weight = np.maximum(weight, 1e-10)[:, None]
    means = s1.reshape(k, d) / weight
    variances = np.maximum(s2.reshape(k, d) / weight - means * means, floor)
    xi = xi.reshape(k, k) + 1e-12
    return Params(start / max(start.sum(), 1e-300), xi / xi.sum(axis=1, keepdims=True), means, variances), float(stats[-2])


def fit_array(x: np.ndarray, k: int = N_STATES, iters: int = N_ITER, tol: float = TOL) -> tuple[Params, float, int]:
    p, last = _initial(x, k), -np.inf
    floor = VAR_FLOOR * np.maximum(x.var(axis=0), 1e-300)
    even = np.full(k, 1.0 / k)
    for i in range(1, iters + 1):
        nxt, llf = _maximise(_expect(x, p, even, even, True), k, x.shape[1], floor)
        if llf - last < tol and i > 1:
            return p, llf, i
        p, last = nxt, llf
    return p, last, iters


def _matrix(pdf: pd.DataFrame, cols: Sequence[str]) -> np.ndarray:
    return np.nan_to_num(pdf[list(cols)].to_numpy(dtype=float))


def _params_of(row) -> Params:
    return Params(row["start"], row["trans"], row["means"], row["vars"])


def hmm_fit(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, n_states: int = N_STATES, iters: int = N_ITER, tol: float = TOL,
    max_rows: int = FIT_ROWS,
) -> DataFrame:
    """Parameters per key by expectation-maximisation on the rows given (the training window).

    Nulls count as 0. Keys of at most `max_rows` rows are fitted whole, one task each; longer ones run
    the same iterations with distributed expectation steps, which give the same parameters.
    """
    keys, cols = list(keys), list(cols)
    rows = cut_lineage(df.select(*keys, IDX, *cols))  # counted, then fitted
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    small = attach(rows, sizes.filter(F.col("_n") <= max_rows).drop("_n"), keys, "left_semi")
    schema = T.StructType([rows.schema[k] for k in keys] + PARAM_FIELDS + STAT_FIELDS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        p, llf, used = fit_array(_matrix(pdf, cols), n_states, iters, tol)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], *p.flat(), llf, used, len(pdf)]], columns=schema.fieldNames())

    fitted = small.groupBy(*keys).applyInPandas(run, schema)
    large = sizes.filter(F.col("_n") > max_rows).drop("_n")
    if not large.limit(1).count():
        return fitted
    big = attach(rows, large, keys, "left_semi")
    return fitted.unionByName(_fit_distributed(big, cols, keys, n_states, iters, tol, CHUNK_ROWS))


def _fit_distributed(rows: DataFrame, cols: list[str], keys: list[str], k: int, iters: int, tol: float, size: int) -> DataFrame:
    """EM with one Spark pass per expectation step; state between passes is one row per key."""
    from barloom.plans.quantiles import exact_quantiles

    d = len(cols)
    rows = rows.fillna(0.0, cols)
    first = rows.groupBy(*keys).agg(F.array(*[F.avg(c) for c in cols]).alias("_mean"), F.array(*[F.var_pop(c) for c in cols]).alias("_var"))
    sized = attach(rows, first, keys).withColumn("_size", F.abs(F.col(cols[0]) - F.get("_mean", F.lit(0))))
    cuts = exact_quantiles(sized, keys, "_size", [i / k for i in range(1, k)], "_cuts")
    grouped = attach(sized, cuts, keys).withColumn("_g", F.expr("size(filter(_cuts, c -> c <= _size))"))
    per = grouped.groupBy(*keys, "_mean", "_var", "_g").agg(F.array(*[F.avg(c) for c in cols]).alias("mu"), F.array(*[F.var_pop(c) for c in cols]).alias("v"))
    packed = per.groupBy(*keys, "_mean", "_var").agg(F.collect_list(F.struct("_g", "mu", "v")).alias("_found"))  # at most k entries
    # a group without rows begins at the mean and variance of all
    of = lambda g: F.get(F.filter("_found", lambda s: s["_g"] == g), F.lit(0))
    filled = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda g: F.struct(F.coalesce(of(g)["mu"], F.col("_mean")).alias("mu"), F.coalesce(of(g)["v"], F.col("_var")).alias("v")))
    packed = packed.withColumn("_s", filled)
    even = Params(np.full(k, 1.0 / k), np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)), np.zeros((k, d)), np.ones((k, d)))
    floored = F.flatten(F.transform("_s", lambda s: F.zip_with(s["v"], F.col("_var"), lambda a, b: F.greatest(a, F.lit(VAR_FLOOR) * F.greatest(b, F.lit(1e-300))))))
    const = lambda a: F.array(*[F.lit(float(v)) for v in np.ravel(a)])
    state = packed.select(
        *keys, "_var", const(even.start).alias("start"), const(even.trans).alias("trans"), F.flatten(F.transform("_s", lambda s: s["mu"])).alias("means"),
        floored.alias("vars"), F.lit(float("-inf")).alias("log_likelihood"), F.lit(0).alias("iterations"), F.lit(0).cast("long").alias("n_rows"), F.lit(False).alias("done"),
    )
    state = written(state)
    chunked = rows.withColumn(CHUNK, F.expr(f"{IDX} div {size}"))
    key_fields = [rows.schema[c] for c in keys]
    stat_schema = T.StructType(key_fields + [T.StructField("stats", _A)])
    out_schema = T.StructType(key_fields + [T.StructField("_var", _A)] + PARAM_FIELDS + STAT_FIELDS + [T.StructField("done", T.BooleanType())])

    def expect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        row = pdf.iloc[0]
        stats = _expect(_matrix(pdf, cols), _params_of(row), np.asarray(row["_in"]), np.asarray(row["_out"]), pdf[IDX].iloc[0] == 0)
        return pd.DataFrame([[*[row[c] for c in keys], stats]], columns=stat_schema.fieldNames())

    def maximise(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        p, llf = _maximise(np.asarray(row["stats"], dtype=float), k, d, VAR_FLOOR * np.maximum(np.asarray(row["_var"], dtype=float), 1e-300))
        done = llf - row["log_likelihood"] < tol and row["iterations"] > 0
        keep = _params_of(row) if done else p
        return pd.DataFrame(
            [[*[row[c] for c in keys], row["_var"], *keep.flat(), llf, int(row["iterations"]) + 1, int(round(row["stats"][-1])), bool(done)]],
            columns=out_schema.fieldNames(),
        )

    from barloom.plans.moments import sum_arrays

    for _ in range(iters):  # each turn is one distributed pass over the open keys
        active = state.filter("NOT done")
        if not active.limit(1).count():
            break
        carried = _carries(chunked, active, cols, keys, size)
        stats = equi(attach(chunked, active.select(*keys, *[f.name for f in PARAM_FIELDS]), keys), carried, [*keys, CHUNK])
        total = sum_arrays(stats.groupBy(*keys, CHUNK).applyInPandas(expect, stat_schema), keys, "stats")
        moved = equi(active, total, keys).groupBy(*keys).applyInPandas(maximise, out_schema)
        old, state = state, written(state.filter("done").select(*out_schema.fieldNames()).unionByName(moved))
        discard(old)
    return state.select(*keys, *[f.name for f in PARAM_FIELDS + STAT_FIELDS])


# --- chunk carries
def _carries(chunked: DataFrame, params: DataFrame, cols: list[str], keys: list[str], size: int) -> DataFrame:
    """keys, chunk, _in (alpha before the chunk), _out (beta after it)."""
    key_fields = [chunked.schema[c] for c in keys]
    prod_schema = T.StructType(key_fields + [T.StructField(CHUNK, T.LongType()), T.StructField("_m", _A)])
    carry_schema = T.StructType(key_fields + [T.StructField(CHUNK, T.LongType()), T.StructField("_in", _A), T.StructField("_out", _A)])

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        m, _ = step_matrices(_matrix(pdf, cols), _params_of(pdf.iloc[0]), pdf[IDX].iloc[0] == 0)
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in keys], pdf[CHUNK].iloc[0], product(m).ravel()]], columns=prod_schema.fieldNames())

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK, ignore_index=True)
        m = np.stack(pdf["_m"].to_numpy())
        k = int(np.sqrt(m.shape[1]))
        m = m.reshape(-1, k, k)
        even = np.full(k, 1.0 / k)
        alpha = np.concatenate([even[None], forward(even, m)[:-1]])
        return pdf.assign(_in=list(alpha), _out=list(backward(even, m)))[carry_schema.fieldNames()]

    joined = attach(chunked, params.select(*keys, *[f.name for f in PARAM_FIELDS]), keys)
    # one row of K x K numbers per chunk of 65,536 rows reaches the scan
    return joined.groupBy(*keys, CHUNK).applyInPandas(multiply, prod_schema).groupBy(*keys).applyInPandas(scan, carry_schema)


def high_vol_state(params: DataFrame, vol_col: int = 0, n_states: int = N_STATES) -> DataFrame:
    """Adds high_vol_state: the state with the largest variance of the chosen column."""
    width = F.floor(F.size("vars") / n_states)
    picks = [F.struct(F.element_at("vars", (width * s + vol_col + 1).cast("int")).alias("v"), F.lit(-s).alias("s")) for s in range(n_states)]
    return params.withColumn("high_vol_state", -F.array_max(F.array(*picks))["s"])


def _posteriors(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str], size: int, smooth: bool, out: str) -> DataFrame:
    keys, cols = list(keys), list(cols)
    # read by the carries and by the posterior pass
    chunked = cut_lineage(df).withColumn(CHUNK, F.expr(f"{IDX} div {size}"))
    slim = chunked.select(*keys, IDX, CHUNK, *cols)
    carried = _carries(slim, params, cols, keys, size)
    names = [f.name for f in PARAM_FIELDS]
    ready = equi(attach(chunked, params.select(*keys, *names), keys), carried, [*keys, CHUNK])
    schema = T.StructType([*df.schema.fields, T.StructField(out, _A)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        row = pdf.iloc[0]
        m, _ = step_matrices(_matrix(pdf, cols), _params_of(row), pdf[IDX].iloc[0] == 0)
        p = forward(np.asarray(row["_in"]), m)
        if smooth:
            p = _unit(p * backward(np.asarray(row["_out"]), m))
        return pdf.assign(**{out: list(p)})[schema.fieldNames()]

    return ready.groupBy(*keys, CHUNK).applyInPandas(run, schema)


def hmm_filter(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, size: int = CHUNK_ROWS) -> DataFrame:
    """`filtered`: P(state at t | observations up to t) per row; depends on nothing after t."""
    return _posteriors(df, params, cols, keys, size, False, "filtered")


def hmm_smooth(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, size: int = CHUNK_ROWS) -> DataFrame:
    """`noncausal_smoothed`: P(state at t | all observations). Diagnostics only, never a feature."""
    return _posteriors(df, params, cols, keys, size, True, "noncausal_smoothed")


def high_vol_probability(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, size: int = CHUNK_ROWS) -> DataFrame:
    """`regime_high_vol_prob`: the filtered probability of the high-volatility state."""
    keys = list(keys)
    params = cut_lineage(params)  # joined three times below
    state = high_vol_state(params).select(*keys, "high_vol_state")
    f = attach(hmm_filter(df, params, cols, keys, size), state, keys)
    return f.withColumn("regime_high_vol_prob", F.get("filtered", F.col("high_vol_state"))).drop("filtered", "high_vol_state")


def fold_regime_feature(
    rows: DataFrame, cols: Sequence[str] = ("ret_1d", "vol_10d"), params: DataFrame | None = None, keys: Sequence[str] = KEYS, n: str = "n_rows", size: int = CHUNK_ROWS
) -> DataFrame:
    """Every row once per fold it belongs to, with its role and `regime_high_vol_prob`, the feature that joins the others
    before scaling: parameters learned from the fold's rows before its test part (or given per key and fold), filtered
    forward over all of the fold's rows, so that no row sees a later one. Missing observations count as 0.
    """
    by = [*keys, "fold"]
    expanded = expand_folds(rows, n)
    seen = expanded.withColumns({f"_o{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(cols)})
    inputs = [f"_o{i}" for i in range(len(cols))]
    if params is None:
        params = hmm_fit(seen.filter("role <> 'test'"), inputs, by)
    return high_vol_probability(seen, params, inputs, by, size).drop(*inputs)


# --- best path
def _max_step(score: np.ndarray, logm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One max-plus step for many rows at once: (.., K) x (.., K, K) -> best score and best previous state."""
    all_ = score[..., :, None] + logm
    return all_.max(axis=-2), all_.argmax(axis=-2)


def _path(score: np.ndarray, logm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    back = np.empty(logm.shape[:2], dtype=np.int64)
    for t in range(len(logm)):
        score, back[t] = _max_step(score, logm[t])
        score = score - score.max()
    return score, back


def hmm_viterbi(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, size: int = CHUNK_ROWS) -> DataFrame:
    """`noncausal_state`: the most likely state path over the whole series. Diagnostics only."""
    keys, cols = list(keys), list(cols)
    chunked = cut_lineage(df).withColumn(CHUNK, F.expr(f"{IDX} div {size}"))
    names = [f.name for f in PARAM_FIELDS]
    ready = attach(chunked.select(*keys, IDX, CHUNK, *cols), params.select(*keys, *names), keys)
    key_fields = [df.schema[c] for c in keys]
    piece = T.StructType(key_fields + [T.StructField(CHUNK, T.LongType()), T.StructField("_m", _A)])
    ends = T.StructType(key_fields + [T.StructField(CHUNK, T.LongType()), T.StructField("_in", _A), T.StructField("_last", T.LongType())])

    def logs(pdf: pd.DataFrame) -> np.ndarray:
        m, _ = step_matrices(_matrix(pdf, cols), _params_of(pdf.iloc[0]), pdf[IDX].iloc[0] == 0)
        return np.log(np.maximum(m, 1e-300))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        logm = logs(pdf)
        k = logm.shape[1]
        # entering in state i for sure, for each i: best score of leaving in state j
        total = np.stack([_entering(i, logm) for i in range(k)])
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in keys], pdf[CHUNK].iloc[0], total.ravel()]], columns=piece.fieldNames())

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK, ignore_index=True)
        m = np.stack(pdf["_m"].to_numpy())
        k = int(np.sqrt(m.shape[1]))
        m = m.reshape(-1, k, k)
        incoming, score = [], np.zeros(k)
        back = []
        for step in m:
            incoming.append(score)
            score, b = _max_step(score, step)
            back.append(b)
            score = score - score.max()
        last, state = [], int(score.argmax())
        for b in reversed(back):
            last.append(state)
            state = int(b[state])
        return pdf.assign(_in=incoming, _last=last[::-1])[ends.fieldNames()]

    schema = T.StructType([*df.schema.fields, T.StructField("noncausal_state", T.IntegerType())])

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        _, back = _path(np.asarray(pdf["_in"].iloc[0], dtype=float), logs(pdf))
        states, state = np.empty(len(pdf), dtype=np.int32), int(pdf["_last"].iloc[0])
        for t in range(len(pdf) - 1, -1, -1):
            states[t] = state
            state = int(back[t, state])
        return pdf.assign(noncausal_state=states)[schema.fieldNames()]

    carried = ready.groupBy(*keys, CHUNK).applyInPandas(summarise, piece).groupBy(*keys).applyInPandas(scan, ends)
    full = equi(attach(chunked, params.select(*keys, *names), keys), carried, [*keys, CHUNK])
    return full.groupBy(*keys, CHUNK).applyInPandas(trace, schema)


def _entering(i: int, logm: np.ndarray) -> np.ndarray:
    """Best log score of ending in each state when the chunk is entered in state i."""
    score = logm[0, i]
    offset = 0.0
    for t in range(1, len(logm)):
        score = (score[:, None] + logm[t]).max(axis=0)
        top = score.max()
        offset, score = offset + top, score - top
    return score + offset
