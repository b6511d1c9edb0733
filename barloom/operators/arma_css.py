"""Conditional sum of squares for ARMA models, by Gauss-Newton steps that are carried over chunks.

With e[t] = y[t] - c - sum phi_i y[t-i] - sum theta_j e[t-j], every derivative of e is the same moving-average filter run
over another input: -1 for c, -y[t-i] for phi_i, -e[t-j] for theta_j. All of these are linear in what they find before a
chunk. So a chunk is worked once, from nothing and from one unit of each earlier innovation, and reports the products of
these basis columns and their last q rows. A scan over one row per chunk then knows the true state before each chunk, turns
the products into the sums of e e', e d and d d' and takes one step. A step that raises the sum of squares is taken back
and halved, so the sum never rises; steps stay among stationary and invertible parameters.

The rows of a chunk are packed once, and each round is one pass over the packed rows and one small row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import equi
from barloom.operators.econometrics import ARMA_CHUNK, _driven, _innovations
from barloom.plans.attach import BROADCAST_BYTES, table_bytes
from barloom.plans.panel import CHUNK, IDX, KEYS, haloed, owned, row_index
from barloom.session import cut_lineage

ROUNDS, SETTLED = 25, 1e-9
_ROOT = 0.9999


def _filtered(u: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return _innovations(u, theta, np.zeros(len(theta))) if len(theta) else u


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[k:] = x[: len(x) - k]
    return out


def basis(y: np.ndarray, mine: int, first: int, const: float, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Columns of a chunk: e from nothing, e from a unit of each of the q earlier innovations, and for c, each phi and each
    theta its derivative from nothing; a theta's also from each unit. `mine` rows of y are the chunk's own, `first` is the
    position of y[0] in its series; rows without p predecessors have no residual, as in the recursion."""
    p, q = len(phi), len(theta)
    begin = len(y) - mine
    live = (np.arange(first + begin, first + len(y)) >= p).astype(float)
    e = _filtered(_driven(y.copy(), first, const, phi)[begin:], theta)
    units = [_innovations(np.zeros(mine), theta, row) for row in np.eye(q)] if q else []
    columns = [e, *units, _filtered(-live, theta)]
    for i in range(1, p + 1):
        columns.append(_filtered(-_lagged(y, i)[begin:] * live, theta))
    for j in range(1, q + 1):
        columns.append(_filtered(-_lagged(e, j), theta))
        for k, u in enumerate(units):  # e[t-j] before the chunk's row j is the state's own row
            into = -_lagged(u, j)
            if k < j and j - 1 - k < mine:
                into[j - 1 - k] -= 1.0
            columns.append(_filtered(into, theta))
    return np.column_stack(columns)


def _selector(state: np.ndarray, p: int, q: int) -> np.ndarray:
    """How the basis columns add up to (e, derivatives) for a state: q earlier values of each of them, newest first."""
    k = 1 + p + q
    out = np.zeros((1 + q + 1 + p + q * (1 + q), 1 + k))
    out[0, 0] = 1.0
    s = state.reshape(1 + k, q)
    out[1 : 1 + q, :] = s.T
    out[1 + q + np.arange(1 + p), 1 + np.arange(1 + p)] = 1.0
    for j in range(q):
        at = 1 + q + 1 + p + j * (1 + q)
        out[at, 2 + p + j] = 1.0
        out[at + 1 : at + 1 + q, 2 + p + j] = s[0]
    return out


def _inside(phi: np.ndarray, theta: np.ndarray) -> bool:
    """Stationary and invertible."""
    for coefs in (-phi, theta):
        if len(coefs) and np.abs(np.roots(np.concatenate([[1.0], coefs]))).max(initial=0.0) >= _ROOT:
            return False
    return True


def _step(sums: np.ndarray, at: np.ndarray, p: int) -> np.ndarray:
    """The Gauss-Newton step from `at`, shortened until its parameters are stationary and invertible."""
    jj, je = sums[1:, 1:], sums[1:, 0]
    scale = np.sqrt(np.maximum(np.diag(jj), 1e-300))
    unit = jj / np.outer(scale, scale)
    move = -np.linalg.lstsq(unit, je / scale, rcond=1e-10)[0] / scale
    for _ in range(40):
        if _inside((at + move)[1 : 1 + p], (at + move)[1 + p :]):
            return move
        move = move / 2
    return np.zeros_like(move)


_STATE = T.StructType([
    T.StructField("seg", T.IntegerType()), T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("best", T.ArrayType(T.DoubleType())),
    T.StructField("move", T.ArrayType(T.DoubleType())), T.StructField("ss", T.DoubleType()), T.StructField("ss_start", T.DoubleType()), T.StructField("nobs", T.LongType()),
    T.StructField("gradient", T.DoubleType()), T.StructField("is_settled", T.BooleanType()), T.StructField("is_open", T.BooleanType()),
])


def _advanced(now: dict, sums: np.ndarray, n: int) -> dict:
    """The state after a pass: `sums` belong to the candidate best + move."""
    p, q = now["p"], now["q"]
    best, move = np.asarray(now["best"], dtype=float), np.asarray(now["move"], dtype=float)
    ss, had = float(sums[0, 0]), now["ss"]
    new = dict(now, nobs=n)
    if n - p <= 1 + p + q or (had is None and not np.isfinite(sums).all()):
        return dict(new, is_open=False)
    if had is None or ss <= had:
        at = best + move
        settled = had is not None and had - ss <= SETTLED * had
        scaled = np.abs(sums[1:, 0]) / np.sqrt(np.maximum(np.diag(sums)[1:] * max(ss, 1e-300), 1e-300))
        step = np.zeros_like(at) if settled else _step(sums, at, p)
        return dict(new, best=at, move=step, ss=ss, ss_start=ss if had is None else now["ss_start"], gradient=float(scaled.max()), is_settled=settled, is_open=not settled)
    move = move / 2
    settled = bool(np.abs(move).max() <= 1e-10 * max(1.0, np.abs(best).max()))
    return dict(new, move=move, is_settled=settled, is_open=not settled)


def css_fit(
    df: DataFrame, ret: str, start: DataFrame, keys: Sequence[str] = KEYS, segment: str | None = None, rounds: int = ROUNDS, size: int | None = None
) -> DataFrame:
    """Parameters of least conditional sum of squares per key (and nested training segment), from those of `start`.

    `start` has const, phi and theta per key (and segment); its orders are kept. Gives keys, [segment], p, q, const, phi,
    theta, ss_start, ss, sigma2, bic, nobs, gradient (the largest scaled one left) and is_settled, FALSE where `rounds`
    passes did not settle. NULL returns are left out; keys without a start, or without more rows than parameters, are not
    fitted and keep their start with NULL sums.
    """
    keys, size = list(keys), size or ARMA_CHUNK
    seg = segment or "_seg"
    start = start if segment else start.withColumn(seg, F.lit(1))
    none = lambda kind: F.lit(None).cast(kind)
    first = F.struct(
        F.col(seg).cast("int").alias("seg"), F.size("phi").alias("p"), F.size("theta").alias("q"), F.concat(F.array(F.col("const").cast("double")), "phi", "theta").alias("best"),
        F.array_repeat(F.lit(0.0), 1 + F.size("phi") + F.size("theta")).alias("move"), none("double").alias("ss"), none("double").alias("ss_start"), none("bigint").alias("nobs"),
        none("double").alias("gradient"), F.lit(False).alias("is_settled"), F.lit(True).alias("is_open"),
    )
    begun = cut_lineage(start.select(*keys, first.alias("state")))
    small = 2 * table_bytes(begun) <= BROADCAST_BYTES  # states keep their size
    depth = max(1, begun.agg(F.max("state.p")).first()[0] or 1)
    rows = df.filter(F.col(ret).isNotNull()).select(*keys, F.col(IDX).alias("_o"), F.col(ret).cast("double").alias("y"), (F.col(segment) if segment else F.lit(1)).cast("int").alias("s"))
    cut = haloed(row_index(rows, keys, "_o").drop("_o"), size, depth)
    one = F.struct(F.col(IDX).alias("i"), "y", "s", owned(size).alias("own"))
    held = cut.groupBy(*keys, CHUNK).agg(F.array_sort(F.collect_list(one)).alias("r"))  # at most size + depth rows
    packed = cut_lineage(held.select(*keys, CHUNK, F.get("r", F.lit(0))["i"].alias("first"), F.size(F.filter("r", lambda x: x["own"])).alias("own"), F.transform("r", lambda x: x["y"]).alias("y"), F.transform("r", lambda x: x["s"].cast("double")).alias("s")))
    kinds = [start.schema[k] for k in keys]
    piece = T.StructType([T.StructField("state", _STATE), T.StructField("n", T.LongType()), T.StructField("products", T.ArrayType(T.DoubleType())), T.StructField("end", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(T.ArrayType(piece))
    def worked(first: pd.Series, own: pd.Series, y: pd.Series, s: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for first, own, y, upto, params in zip(first, own, y, s, asked):
            y, upto = np.asarray(y, dtype=float), np.asarray(upto, dtype=float)
            begin, found = len(y) - own, []
            for a in params:
                p, q, at = a["p"], a["q"], np.asarray(a["best"], dtype=float) + np.asarray(a["move"], dtype=float)
                n = int((upto[begin:] <= a["seg"]).sum())  # a segment's rows come before all others
                if n:
                    b = basis(y[: begin + n], n, first, at[0], at[1 : 1 + p], at[1 + p :])
                    end = b[::-1][:q]
                    if n < q:
                        end = np.vstack([end, np.zeros((q - n, b.shape[1]))])
                    found.append({"state": a, "n": n, "products": (b.T @ b).ravel(), "end": end.ravel()})
            out.append(found)
        return pd.Series(out)

    after_type = T.StructType([*kinds, T.StructField("seg", T.IntegerType()), T.StructField("state", _STATE)])

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row per chunk of a key's segment, in order: the sums at its candidate, and what to try next."""
        pdf = pdf.sort_values(CHUNK, ignore_index=True)
        now = pdf["state"].iloc[0]
        now = {f.name: now[f.name] for f in _STATE}
        p, q = now["p"], now["q"]
        before, sums = np.zeros((2 + p + q) * q), 0.0
        for flat, end in zip(pdf["products"], pdf["end"]):
            pick = _selector(before, p, q)
            k = len(pick)
            sums = sums + pick.T @ np.asarray(flat).reshape(k, k) @ pick
            before = (np.asarray(end).reshape(q, k) @ pick).T.ravel() if q else before
        new = _advanced(now, sums, int(pdf["n"].sum()))
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "seg": [now["seg"]], "state": [new]})[after_type.fieldNames()]

    ended, table = [], begun
    for _ in range(rounds):
        asked = table.groupBy(*keys).agg(F.collect_list("state").alias("asked"))  # one entry a segment
        met = equi(packed, F.broadcast(asked) if small else asked, keys)
        pieces = met.select(*keys, CHUNK, F.explode(worked("first", "own", "y", "s", "asked")).alias("w")).select(*keys, CHUNK, F.col("w.state.seg").alias("seg"), "w.*")
        after = cut_lineage(pieces.groupBy(*keys, "seg").applyInPandas(advance, after_type).drop("seg"))
        ended.append(after.filter(~F.col("state.is_open")))
        table = after.filter("state.is_open")
        if not table.limit(1).count():
            break
    for part in ended:
        table = table.unionByName(part)
    given = begun.select(*keys, F.col("state.seg").alias(seg), F.col("state").alias("begun"))
    fitted = equi(given, table.select(*keys, F.col("state.seg").alias(seg), "state"), [*keys, seg], "left")
    s = fitted.select(*keys, seg, F.coalesce("state", "begun").alias("s")).select(*keys, seg, *[F.col(f"s.{f.name}") for f in _STATE if f.name != "seg"])
    used = F.col("nobs") - F.col("p")
    return s.select(
        *keys, *([seg] if segment else []), "p", "q", F.get("best", F.lit(0)).alias("const"), F.slice("best", F.lit(2), F.col("p")).alias("phi"), F.slice("best", 2 + F.col("p"), F.col("q")).alias("theta"),
        "ss_start", "ss", (F.col("ss") / used).alias("sigma2"), (used * F.ln(F.col("ss") / used) + F.ln(used) * (F.col("p") + F.col("q") + 2)).alias("bic"), "nobs", "gradient", "is_settled",
    )
