"""Unit-root, order-selection, ARDL, bounds, cointegration and ARMA jobs for a whole panel.

Series enter as `row_idx`-indexed panels. The data pass is `lag_moments` / windows; the solvers below
see one small matrix per key.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import equi, ratio
from barloom.operators.features import difference
from barloom.plans.attach import attach
from barloom.plans.moments import Moments, gaussian_llf, lag_moments, lag_names, lag_products, standardise
from barloom.plans.panel import CHUNK, IDX, KEYS, haloed, in_order, mapped, owned, row_index, running, windowed
from barloom.session import cut_lineage

LEVEL, MIN_OBS = 0.05, 20
# Fixed values, published: MacKinnon (1994) response surfaces for one and two variables, constant case.
TAU_STAR = {1: -1.61, 2: -2.62}
TAU_MIN = {1: -18.83, 2: -18.86}
TAU_MAX = {1: 2.74, 2: 0.92}
TAU_SMALL = {1: (2.1659, 1.4412, 0.038269), 2: (2.92, 1.5012, 0.039796)}
TAU_LARGE = {1: (1.7339, 0.93202, -0.12745, -0.010368), 2: (2.1945, 0.64695, -0.29198, -0.042377)}
# Fixed values, published: MacKinnon (2010) critical values at 1%, 5%, 10% in powers of 1/n.
TAU_CRIT = {
    1: ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)),
    2: ((-3.89644, -10.9519, -22.527, 0.0), (-3.33613, -6.1101, -6.823, 0.0), (-3.04445, -4.2412, -2.720, 0.0)),
}
# Fixed values, published: Kwiatkowski et al. (1992) critical values at 10%, 5%, 2.5%, 1%.
KPSS_CRIT = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
KPSS_P = (0.10, 0.05, 0.025, 0.01)
# Fixed values, published: Pesaran, Shin and Smith (2001) 5% bounds, case III, by number of regressors.
BOUNDS_5PCT = {1: (4.94, 5.73), 2: (3.79, 4.85), 3: (3.23, 4.35), 4: (2.86, 4.01), 5: (2.62, 3.79)}


def _normal_cdf(x: float) -> float:
    from statistics import NormalDist

    return NormalDist().cdf(x)


def tau_p_value(stat: float, n_vars: int = 1) -> float:
    if stat > TAU_MAX[n_vars]:
        return 1.0
    if stat < TAU_MIN[n_vars]:
        return 0.0
    coef = TAU_SMALL[n_vars] if stat <= TAU_STAR[n_vars] else TAU_LARGE[n_vars]
    return _normal_cdf(sum(c * stat**i for i, c in enumerate(coef)))


def prepared(df: DataFrame, value: str, keys: Sequence[str], order: str = IDX) -> DataFrame:
    """Non-null values with a gap-free position and the length per key, written once: the tests read them several times."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(value).alias("y"))
    return cut_lineage(row_index(rows, keys, "_o", length="n_rows").drop("_o"))


# --- unit roots
_ADF = T.StructType(
    [T.StructField("adf_statistic", T.DoubleType()), T.StructField("p_value", T.DoubleType()), T.StructField("used_lag", T.IntegerType()),
     T.StructField("nobs", T.LongType()), T.StructField("icbest", T.DoubleType())]
    + [T.StructField(f"crit_{p}", T.DoubleType()) for p in (1, 5, 10)]
)


def _adf_solve(flat, head, lag: int, trend: str, n_vars: int):
    """Dickey-Fuller regression: lag by AIC on the common sample, statistic on the longest sample."""
    base = ["1"] if trend == "c" else []

    def regressors(p: int) -> list[str]:
        return ["level", *[f"d{i}" for i in range(1, p + 1)], *base]

    rows = {"1": {"1": 1.0}, "dy": {"y0": 1.0, "y1": -1.0}, "level": {"y1": 1.0}}
    rows |= {f"d{i}": {f"y{i}": 1.0, f"y{i + 1}": -1.0} for i in range(1, lag + 1)}
    m = Moments(flat, lag_names(["y"], lag + 1)).mix(rows)
    best, icbest = 0, np.inf
    for p in range(lag + 1):
        try:
            _, ssr, _ = m.ols("dy", regressors(p))
        except np.linalg.LinAlgError:
            continue
        aic = -2.0 * gaussian_llf(m.n, ssr) + 2.0 * len(regressors(p))
        if aic < icbest:
            best, icbest = p, aic
    head = np.asarray(head, dtype=float)
    early = [
        [1.0, head[t] - head[t - 1], head[t - 1]] + [head[t - i] - head[t - i - 1] if i <= best else 0.0 for i in range(1, lag + 1)]
        for t in range(best + 1, min(lag + 1, len(head)))
    ]
    if early:
        m = m.plus(np.array(early))
    x = regressors(best)
    beta, ssr, inverse = m.ols("dy", x)
    se = np.sqrt(ssr / (m.n - len(x)) * inverse[0, 0])
    return beta[0] / se, best, int(round(m.n)), icbest


def adf_screen(
    df: DataFrame, value: str, keys: Sequence[str] = KEYS, order: str = IDX, trend: str = "c", n_vars: int = 1,
    level: float = LEVEL, max_lag: int | None = None, size: int | None = None,
) -> DataFrame:
    """Augmented Dickey-Fuller test per key; series below 20 observations report (False, p = 1)."""
    keys = list(keys)
    rows = prepared(df, value, keys, order)
    lag = F.least(F.ceil(12.0 * F.pow(F.col("n_rows") / 100.0, F.lit(0.25))), F.floor(F.col("n_rows") / 2) - (2 if trend == "c" else 1))
    if max_lag is not None:
        lag = F.least(lag, F.lit(max_lag))
    rows = rows.withColumn("lag", F.greatest(lag, F.lit(0)).cast("int")).withColumn("span", F.col("lag") + 1)
    sizes = rows.groupBy(*keys).agg(F.first("n_rows").alias("n_rows"), F.first("lag").alias("lag"))
    usable = rows.filter(F.col("n_rows") >= MIN_OBS)
    # residuals have mean zero already: without a constant the test must not centre them
    z = standardise(usable, ["y"], keys)
    z = z.withColumn("z_y", F.col("z_y") if trend == "c" else F.col("y") / F.coalesce(F.nullif("sd_y", F.lit(0.0)), F.lit(1.0)))
    longest = sizes.agg(F.max("lag")).first()[0]  # one number: bounds the halo
    if longest is None:
        longest = 0
    m = lag_moments(z, ["z_y"], int(longest) + 1, keys, lag_col="span", size=size)
    head = (
        z.filter(F.col(IDX) <= F.col("span"))
        .groupBy(*keys)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct(IDX, "z_y"))), lambda s: s["z_y"]).alias("head"))
    )
    one = equi(equi(sizes, m, keys, "left"), head, keys, "left")

    @F.pandas_udf(_ADF)
    def solve(moments: pd.Series, heads: pd.Series, lags: pd.Series) -> pd.DataFrame:
        out = []
        for g, h, p in zip(moments, heads, lags):
            try:
                if g is None:
                    raise ValueError
                stat, used, n, ic = _adf_solve(g, h, int(p), trend, n_vars)
                crit = [sum(c / n**i for i, c in enumerate(cs)) for cs in TAU_CRIT[n_vars]]
                out.append([stat, tau_p_value(stat, n_vars), used, n, ic, *crit])
            except (ValueError, np.linalg.LinAlgError):
                out.append([None, 1.0, None, None, None, None, None, None])
        return pd.DataFrame(out, columns=_ADF.fieldNames()).astype({"used_lag": "Int32", "nobs": "Int64"})

    out = one.withColumn("_s", solve("moments", "head", "lag")).select(*keys, "n_rows", "_s.*")
    return out.withColumn("is_stationary", F.col("p_value") < level)


def _kpss_p(stat: Column, trend: str) -> Column:
    crit = KPSS_CRIT[trend]
    out = F.when(stat <= crit[0], KPSS_P[0])
    for i in range(3):
        slope = (KPSS_P[i + 1] - KPSS_P[i]) / (crit[i + 1] - crit[i])
        out = out.when(stat <= crit[i + 1], KPSS_P[i] + (stat - crit[i]) * slope)
    return out.otherwise(KPSS_P[3])


def kpss_screen(
    df: DataFrame, value: str, keys: Sequence[str] = KEYS, order: str = IDX, trend: str = "c", lags: int | str = "auto",
    level: float = LEVEL, size: int | None = None,
) -> DataFrame:
    """KPSS test per key. Partial sums are a two-level running sum; autocovariances are lag products.

    lags: a number, or "auto" for the data-driven bandwidth. Short series report (False, p = 0).
    """
    keys = list(keys)
    rows = prepared(df, value, keys, order)
    n = F.col("n_rows")
    fit = rows.groupBy(*keys).agg(
        F.first("n_rows").alias("_n"), F.avg("y").alias("_m"), F.regr_slope("y", IDX).alias("_b"), F.regr_intercept("y", IDX).alias("_a")
    )
    line = F.col("_m") if trend == "c" else F.col("_a") + F.col("_b") * F.col(IDX)
    resid = attach(rows, fit, keys).withColumn("e", F.col("y") - line).select(*keys, IDX, "n_rows", "e")
    eta = running(resid, {"s": ("sum", "e")}, keys).groupBy(*keys).agg(
        F.first("n_rows").alias("n_rows"), (F.sum(F.col("s") * F.col("s")) / F.pow(F.first("n_rows"), F.lit(2.0))).alias("_eta")
    )
    if lags == "auto":
        short = resid.withColumn("lag", F.least(F.floor(F.pow(n, F.lit(2.0 / 9.0))), n - 1).cast("int"))
        top = short.agg(F.max("lag")).first()[0] or 0  # one number: bounds the halo
        first = lag_products(short, "e", int(top), keys, "lag", size)
        half = first.withColumn("_half", F.transform("products", lambda p, i: F.when(i == 0, 0.0).otherwise(p)))
        s0 = F.try_element_at("products", F.lit(1)) / F.col("n_rows") + F.aggregate("_half", F.lit(0.0), lambda a, p: a + p) / (F.col("n_rows") / 2.0)
        s1 = F.aggregate(F.transform("_half", lambda p, i: p * i), F.lit(0.0), lambda a, p: a + p) / (F.col("n_rows") / 2.0)
        bandwidth = 1.1447 * F.pow(F.pow(ratio(s1, s0), F.lit(2.0)), F.lit(1.0 / 3.0))
        chosen = equi(half, eta.select(*keys, "n_rows"), keys).select(
            *keys, F.coalesce(F.least(F.floor(bandwidth * F.pow("n_rows", F.lit(1.0 / 3.0))), F.col("n_rows") - 1), F.lit(0)).cast("int").alias("lag")
        )
        widest = chosen.agg(F.max("lag")).first()[0] or 0
        sums = lag_products(attach(resid, chosen, keys), "e", int(widest), keys, "lag", size)
        sums = equi(sums, chosen, keys)
    else:
        prods = windowed(
            resid, lambda d, w: d.withColumns({f"_p{k}": F.col("e") * F.lag("e", k).over(w) for k in range(lags + 1)}), back=max(lags, 1), keys=keys
        )
        sums = prods.groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) for k in range(lags + 1)]).alias("products"))
        sums = sums.withColumn("lag", F.lit(lags))
    weighted = F.transform("products", lambda p, i: F.when(i == 0, p).otherwise(2.0 * (1.0 - i / (F.col("lag") + 1.0)) * p))
    both = equi(eta, sums, keys).withColumn("_s2", F.aggregate(weighted, F.lit(0.0), lambda a, p: a + p) / F.col("n_rows"))
    stat = ratio("_eta", "_s2")
    enough = (F.col("n_rows") >= MIN_OBS) & stat.isNotNull()
    out = both.select(*keys, "n_rows", F.when(enough, stat).alias("kpss_statistic"), F.col("lag").alias("lags"))
    out = out.withColumn("p_value", F.when(F.col("kpss_statistic").isNull(), 0.0).otherwise(_kpss_p(F.col("kpss_statistic"), trend)))
    return out.withColumn("is_stationary", F.col("p_value") > level)


def stationarity_consensus(
    df: DataFrame, value: str, keys: Sequence[str] = KEYS, order: str = IDX, max_lag: int | None = None, kpss_lags: int | str = "auto"
) -> DataFrame:
    """Both tests must call the series stationary."""
    a = adf_screen(df, value, keys, order, max_lag=max_lag).select(*keys, F.col("p_value").alias("adf_p"), F.col("is_stationary").alias("adf_stationary"))
    k = kpss_screen(df, value, keys, order, lags=kpss_lags).select(*keys, F.col("p_value").alias("kpss_p"), F.col("is_stationary").alias("kpss_stationary"))
    return equi(a, k, list(keys)).withColumn("is_stationary", F.col("adf_stationary") & F.col("kpss_stationary"))


def difference_ladder(df: DataFrame, value: str, keys: Sequence[str] = KEYS, orders: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """keys, d, row_idx, y: the series differenced d times, all orders stacked."""
    wide = windowed(
        df.select(*keys, IDX, value), lambda f, w: f.withColumns({f"d{d}": difference(value, w, d) for d in orders}), back=max(max(orders), 1), keys=keys
    )
    rows = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"d{d}").alias("y")) for d in orders])
    return wide.select(*keys, IDX, F.inline(rows)).filter("y IS NOT NULL")


def auto_difference(df: DataFrame, value: str, keys: Sequence[str] = KEYS, max_order: int = 2, **lags) -> DataFrame:
    """Smallest order whose differenced series passes both tests, else max_order with passed = false."""
    ladder = difference_ladder(df, value, keys, tuple(range(max_order + 1)))
    tested = stationarity_consensus(ladder, "y", [*keys, "d"], **lags)
    pick = tested.groupBy(*keys).agg(F.min(F.when(F.col("is_stationary"), F.col("d"))).alias("_d"))
    return pick.select(*keys, F.coalesce("_d", F.lit(max_order)).alias("diff_order"), F.col("_d").isNotNull().alias("passed"))


def integration_order(df: DataFrame, value: str, keys: Sequence[str] = KEYS, level: float = LEVEL, max_lag: int | None = None) -> DataFrame:
    tested = adf_screen(difference_ladder(df, value, keys, (0, 1)), "y", [*keys, "d"], max_lag=max_lag)
    p = tested.groupBy(*keys).agg(
        F.max(F.when(F.col("d") == 0, F.col("p_value"))).alias("p_level"), F.max(F.when(F.col("d") == 1, F.col("p_value"))).alias("p_diff")
    )
    order = F.when(F.col("p_level") < level, "I(0)").when(F.col("p_diff") < level, "I(1)").otherwise("I(2)+")
    return p.withColumn("integration", order)


# --- autoregressions and ARDL
def _unscale(beta: np.ndarray, terms: list[str], means: dict[str, float], sds: dict[str, float]) -> np.ndarray:
    """Coefficients of standardised (without a constant: scaled) columns back in units of the data."""
    out = beta * sds["y"]
    for i, name in enumerate(terms):
        if name != "1":
            out[i] /= sds[name.rstrip("0123456789")]
    if "1" in terms:
        at = terms.index("1")
        out[at] += means["y"] - sum(out[i] * means[n.rstrip("0123456789")] for i, n in enumerate(terms) if i != at)
    return out


_ARDL = T.StructType(
    [T.StructField("order", T.ArrayType(T.IntegerType())), T.StructField("coefs", T.ArrayType(T.DoubleType())), T.StructField("terms", T.ArrayType(T.StringType())),
     T.StructField("aic", T.DoubleType()), T.StructField("bic", T.DoubleType()), T.StructField("llf", T.DoubleType()), T.StructField("r2", T.DoubleType()),
     T.StructField("nobs", T.LongType()), T.StructField("is_fallback", T.BooleanType())]
)


#: Deterministic terms of each trend: constant, and the row's position (from 1).
TRENDS = {"n": (), "c": ("1",), "t": ("t",), "ct": ("1", "t")}


def _ardl_terms(order: Sequence[int], xs: Sequence[str], trend: str = "c", causal: bool = False) -> list[str]:
    """Deterministic terms, own lags 1..p, then lags 0..q (causal: 1..q) of every regressor."""
    return [*TRENDS[trend], *[f"y{i}" for i in range(1, order[0] + 1)], *[f"{c}{j}" for c, q in zip(xs, order[1:]) for j in range(int(causal), q + 1)]]


def _pick_order(
    m: Moments, xs: Sequence[str], p_max: int, q_max: int, criterion: str, q_min: int = 0, fixed: Sequence[int] | None = None, trend: str = "c", causal: bool = False
):
    grid = [tuple(fixed)] if fixed else itertools.product(range(1, p_max + 1), *[range(q_min, q_max + 1)] * len(xs))
    best = None
    for order in grid:
        terms = _ardl_terms(order, xs, trend, causal)
        try:
            beta, ssr, _ = m.ols("y0", terms)
        except np.linalg.LinAlgError:
            continue
        llf, k = gaussian_llf(m.n, ssr), len(terms) + 1
        ic = {"aic": -2 * llf + 2 * k, "bic": -2 * llf + np.log(m.n) * k}
        if best is None or ic[criterion] < best[0]:
            best = (ic[criterion], order, terms, beta, ssr, llf, ic)
    return best


def _with_trend(m: Moments, trend: str, means: dict[str, float], sds: dict[str, float]) -> Moments:
    """The matrix with the position as `t`; without a constant, columns are scaled only, as centring would bring one in."""
    level = (lambda c: means[c] / sds[c]) if "1" not in TRENDS[trend] else (lambda c: 0.0)
    rows = {"1": {"1": 1.0}}
    for name in m.names[1:]:
        c = name.rstrip("0123456789")
        if c != "t":
            rows[name] = {name: 1.0, "1": level(c)}
    if "t0" in m.names:
        rows["t"] = {"t0": 1.0, "1": level("t")}
    return m.mix(rows)


def _wide_moments(df: DataFrame, y: str, xs: Sequence[str], keys: list[str], order: str, lag: int, size: int | None, position: bool = False) -> tuple[DataFrame, list[str]]:
    """One row per key: moments of the standardised columns and their means and deviations."""
    names = [f"x{chr(97 + i)}" for i in range(len(xs))]
    rows = df.select(*keys, F.col(order).alias("_o"), F.col(y).alias("y"), *[F.col(c).alias(n) for c, n in zip(xs, names)]).na.drop(subset=["y", *names])
    rows = cut_lineage(row_index(rows, keys, "_o").drop("_o"))
    rows = rows.withColumn("t", (F.col(IDX) + 1).cast("double"))
    every = ["y", *names, *(["t"] if position else [])]
    z = standardise(rows, every, keys)
    m = lag_moments(z, [f"z_{c}" for c in every], lag, keys, size=size)
    stats = rows.groupBy(*keys).agg(
        F.array(*[F.avg(c) for c in every]).alias("means"),
        F.array(*[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)) for c in every]).alias("sds"),
        F.max_by("y", IDX).alias("last_y"), F.count(F.lit(1)).alias("n_rows"),
    )
    tail = F.col("n_all") - F.col(IDX) <= lag
    sized = attach(rows, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all")), keys)
    recent = sized.filter(tail).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col(IDX)).alias("i"), F.array("y", *names).alias("v")))), lambda s: s["v"]).alias("recent")
    )
    return equi(equi(m, stats, keys), recent, keys), names


def ardl_fit(
    df: DataFrame, y: str, xs: Sequence[str] = (), keys: Sequence[str] = KEYS, order: str = IDX, max_lags: int = 8, criterion: str = "bic",
    fixed_order: Sequence[int] | None = None, size: int | None = None, trend: str = "c", causal: bool | None = None,
) -> DataFrame:
    """ARDL(p, q...) per key with trend n, c, t or ct; the order minimises the criterion on a common sample.

    All candidate orders are solved from one moment matrix. Causal models leave out a regressor's own row; models of a fixed
    order are causal unless told otherwise. A singular design falls back to a pure AR and is flagged. R2 is about the
    mean with a constant and about zero without. Keeps what `ardl_forecast` needs: the most recent rows and their number.
    """
    keys = list(keys)
    if trend not in TRENDS:
        raise ValueError(f"trend is one of {', '.join(TRENDS)}")
    causal = bool(fixed_order) if causal is None else causal
    lag = max(fixed_order) if fixed_order else max_lags
    one, names = _wide_moments(df, y, xs, keys, order, max(lag, 1), size, "t" in TRENDS[trend])
    every = ["y", *names, *(["t"] if "t" in TRENDS[trend] else [])]

    @F.pandas_udf(_ARDL)
    def solve(moments: pd.Series, means: pd.Series, sds: pd.Series) -> pd.DataFrame:
        out = []
        for g, mu, sd in zip(moments, means, sds):
            mu, sd = dict(zip(every, mu)), dict(zip(every, sd))
            m = _with_trend(Moments(g, lag_names(every, max(lag, 1))), trend, mu, sd)
            best, fallback = _pick_order(m, names, lag, lag, criterion, fixed=fixed_order, trend=trend, causal=causal), False
            if best is None:
                best, fallback = _pick_order(m, [], lag, 0, criterion, trend=trend), True
            if best is None:
                out.append([None] * 8 + [True])
                continue
            _, chosen, terms, beta, ssr, llf, ic = best
            shift = m.n * np.log(sd["y"])  # likelihood in units of the data
            sst = m.g[1, 1] - (m.g[0, 1] ** 2 / m.n if "1" in terms else 0.0)
            out.append(
                [list(chosen), _unscale(beta, terms, mu, sd), terms, ic["aic"] + 2 * shift, ic["bic"] + 2 * shift, llf - shift, 1 - ssr / sst, int(round(m.n)), fallback]
            )
        return pd.DataFrame(out, columns=_ARDL.fieldNames()).astype({"nobs": "Int64"})

    return one.withColumn("_s", solve("moments", "means", "sds")).select(*keys, "_s.*", "last_y", "n_rows", "recent")


def ar_order_select(df: DataFrame, y: str, keys: Sequence[str] = KEYS, order: str = IDX, max_lags: int = 8, criterion: str = "bic") -> DataFrame:
    """Number of own lags minimising the criterion."""
    fit = ardl_fit(df, y, (), keys, order, max_lags, criterion)
    return fit.select(*keys, F.col("order")[0].alias("lags"), "aic", "bic", "nobs")


def ardl_forecast(
    fit: DataFrame, h: int, n_regressors: int = 0, keys: Sequence[str] = KEYS, future: DataFrame | None = None, xs: Sequence[str] = (), actual: str | None = None
) -> DataFrame:
    """keys, step, forecast for steps 1..h. A failed fit repeats the last value.

    `future` has keys, step and the regressors `xs` of the rows to come, in the order of the fit; what it lacks keeps its
    last value. Dynamic by default: later steps build on earlier forecasts. With `actual`, a column of `future`, forecasts
    are static: each step builds on the values that came true before it, and on forecasts only where those are missing.
    """
    keys = list(keys)
    names = ["y", *[f"x{chr(97 + i)}" for i in range(n_regressors)]]
    if future is None:
        given = fit.withColumn("_future", F.lit(None).cast("array<struct<step:int,v:array<double>>>"))
    else:
        value = F.array(*[(F.col(c) if c else F.lit(None)).cast("double") for c in (actual, *xs)])
        ahead = future.filter(F.col("step").between(1, h)).groupBy(*keys).agg(F.collect_list(F.struct(F.col("step").cast("int").alias("step"), value.alias("v"))).alias("_future"))  # at most h a key
        given = equi(fit, ahead, keys, "left")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(coefs: pd.Series, terms: pd.Series, recent: pd.Series, last: pd.Series, n_rows: pd.Series, future: pd.Series) -> pd.Series:
        out = []
        for beta, term, rows, y_last, n, known in zip(coefs, terms, recent, last, n_rows, future):
            if beta is None:
                out.append([y_last] * h)
                continue
            ahead = np.full((h, len(names)), np.nan)
            for row in known if known is not None else ():
                ahead[row["step"] - 1] = [np.nan if v is None else v for v in row["v"]]
            past = np.array([list(r) for r in rows][::-1], dtype=float)  # oldest first
            line, path = np.vstack([past, np.zeros((h, len(names)))]), []
            for k in range(h):
                at = len(past) + k
                line[at, 1:] = np.where(np.isnan(ahead[k, 1:]), line[at - 1, 1:], ahead[k, 1:])
                step = 0.0
                for b, t in zip(beta, term):
                    c = t.rstrip("0123456789")
                    step += b * (1.0 if t == "1" else n + k + 1 if c == "t" else line[at - int(t[len(c) :]), names.index(c)])
                path.append(step)
                line[at, 0] = step if np.isnan(ahead[k, 0]) else ahead[k, 0]
            out.append(path)
        return pd.Series(out)

    steps = given.withColumn("_p", run("coefs", "terms", "recent", "last_y", "n_rows", "_future"))
    return steps.select(*keys, F.posexplode("_p").alias("_i", "forecast")).select(*keys, (F.col("_i") + 1).alias("step"), "forecast")


def model_diagnostics(resid: DataFrame, e: str, actual: str, n_params: int, by: Sequence[str] = KEYS) -> DataFrame:
    """Likelihood, criteria and pseudo R2 from a residual table."""
    g = resid.groupBy(*by).agg(
        F.count(e).alias("n"), F.sum(F.col(e) * F.col(e)).alias("ssr"), (F.var_pop(actual) * F.count(actual)).alias("sst"), F.avg(e).alias("mean_residual")
    )
    llf = -F.col("n") / 2.0 * (np.log(2 * np.pi) + F.ln(F.col("ssr") / F.col("n")) + 1.0)
    g = g.withColumn("llf", llf)
    return g.select(
        *by, "n", "ssr", "mean_residual", "llf", (-2.0 * F.col("llf") + 2.0 * n_params).alias("aic"), (-2.0 * F.col("llf") + F.ln("n") * n_params).alias("bic"),
        (1.0 - ratio("ssr", "sst")).alias("pseudo_r2"),
    )


def ar1_residuals(df: DataFrame, value: str = "close", keys: Sequence[str] = KEYS) -> DataFrame:
    """One-lag regression per key and its residuals, all native."""
    lagged = windowed(df, lambda d, w: d.withColumn("_prev", F.lag(value).over(w)), back=1, keys=keys).filter("_prev IS NOT NULL")
    fit = lagged.groupBy(*keys).agg(F.regr_slope(value, "_prev").alias("slope"), F.regr_intercept(value, "_prev").alias("intercept"))
    return attach(lagged, fit, keys).withColumn("residual", F.col(value) - F.col("intercept") - F.col("slope") * F.col("_prev")).drop("_prev")


_BOUNDS = T.StructType(
    [T.StructField("f_statistic", T.DoubleType()), T.StructField("order", T.ArrayType(T.IntegerType())), T.StructField("forced_min_order", T.BooleanType()),
     T.StructField("ec_speed", T.DoubleType()), T.StructField("long_run", T.ArrayType(T.DoubleType())), T.StructField("nobs", T.LongType())]
)


#: Deterministic terms of the five cases, and those that the test restricts together with the levels.
BOUNDS_CASES = {1: ("n", ()), 2: ("c", ("1",)), 3: ("c", ()), 4: ("ct", ("t",)), 5: ("ct", ())}


def bounds_f_screen(
    df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = KEYS, order: str = IDX, max_lags: int = 5, criterion: str = "bic",
    bounds: tuple[float, float] | None = None, size: int | None = None, case: int = 3, fixed_order: Sequence[int] | None = None,
) -> DataFrame:
    """Bounds test for a level relation via the unrestricted error-correction form, in one of the five cases.

    has_relation is TRUE above the upper bound, FALSE below the lower one and NULL in between. Bounds are tabled for case 3;
    other cases need `bounds`.
    """
    keys = list(keys)
    if case not in BOUNDS_CASES:
        raise ValueError("case is 1 to 5")
    if bounds is None and (case != 3 or len(xs) not in BOUNDS_5PCT):
        raise ValueError(f"no bounds are tabled for {len(xs)} regressors in case {case}: pass bounds=(lower, upper)")
    lower, upper = bounds or BOUNDS_5PCT[len(xs)]
    trend, restricted = BOUNDS_CASES[case]
    if fixed_order:
        max_lags = max(1, *fixed_order)
    one, names = _wide_moments(df, y, xs, keys, order, max_lags + 1, size, "t" in TRENDS[trend])
    every = ["y", *names, *(["t"] if "t" in TRENDS[trend] else [])]

    @F.pandas_udf(_BOUNDS)
    def solve(moments: pd.Series, means: pd.Series, sds: pd.Series) -> pd.DataFrame:
        out = []
        for g, mu, sd in zip(moments, means, sds):
            try:
                m = _with_trend(Moments(g, lag_names(every, max_lags + 1)), trend, dict(zip(every, mu)), dict(zip(every, sd)))
                best = _pick_order(m, names, max_lags, max_lags, criterion, fixed=fixed_order, trend=trend)
                forced = best is not None and all(q == 0 for q in best[1][1:])
                if forced:
                    best = _pick_order(m, names, max_lags, max_lags, criterion, q_min=1, trend=trend)
                p, *qs = best[1]
                levels = [f"L{c}" for c in ("y", *names)]
                rows = {"1": {"1": 1.0}, "dy": {"y0": 1.0, "y1": -1.0}} | {f"L{c}": {f"{c}1": 1.0} for c in ("y", *names)}
                if "t" in TRENDS[trend]:
                    rows["t"] = {"t": 1.0}
                short = [f"Dy{i}" for i in range(1, p)] + [f"D{c}{j}" for c, q in zip(names, qs) for j in range(q)]
                rows |= {f"Dy{i}": {f"y{i}": 1.0, f"y{i + 1}": -1.0} for i in range(1, p)}
                rows |= {f"D{c}{j}": {f"{c}{j}": 1.0, f"{c}{j + 1}": -1.0} for c, q in zip(names, qs) for j in range(q)}
                e = m.mix(rows)
                fixed = list(TRENDS[trend])
                beta, free, _ = e.ols("dy", [*levels, *fixed, *short])
                kept = [*(t for t in fixed if t not in restricted), *short]
                tied = e.ols("dy", kept)[1] if kept else float(e.g[e.names.index("dy"), e.names.index("dy")])
                k = len(levels) + len(restricted)
                f_stat = ((tied - free) / k) / (free / (e.n - len(levels) - len(fixed) - len(short)))
                long_run = [-beta[1 + i] / beta[0] * sd[0] / sd[1 + i] for i in range(len(names))]
                out.append([f_stat, [p, *qs], forced, beta[0], long_run, int(round(e.n))])
            except (TypeError, np.linalg.LinAlgError, ZeroDivisionError):
                out.append([None] * 6)
        return pd.DataFrame(out, columns=_BOUNDS.fieldNames()).astype({"nobs": "Int64"})

    res = one.withColumn("_s", solve("moments", "means", "sds")).select(*keys, "_s.*")
    return res.withColumn("has_relation", F.when(F.col("f_statistic") > upper, True).when(F.col("f_statistic") < lower, False))


def bounds_guarded(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """`bounds_f_screen` with the integration order of each series beside the verdict, as a map by column, and `is_valid`,
    FALSE where one of them is still not stationary after one difference: the test assumes orders of at most one.

    The orders of all series come from one ladder of levels and differences, stacked by column.
    """
    keys = list(keys)
    stacked = df.select(*keys, IDX, F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("v")) for c in (y, *xs)])).alias("s")).select(*keys, IDX, "s.*").filter("v IS NOT NULL")
    placed = row_index(stacked.withColumnRenamed(IDX, "_o"), [*keys, "series"], "_o").drop("_o")
    orders = integration_order(placed, "v", [*keys, "series"]).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "integration")))).alias("integration_orders"), F.bool_and(F.col("integration") != "I(2)+").alias("is_valid")
    )
    return equi(bounds_f_screen(df, y, xs, keys, **options), orders, keys, "left")


def cointegration_residuals(pairs: DataFrame, keys: Sequence[str] = ("a", "b"), order: str = "bar_date") -> DataFrame:
    """Stage one: y on x with a constant per pair; slope, intercept and the residual per row."""
    fit = pairs.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    out = attach(pairs, fit, keys).withColumn("residual", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))
    return out.select(*keys, order, "slope", "intercept", "residual")


def cointegration_screen(pairs: DataFrame, keys: Sequence[str] = ("a", "b"), order: str = "bar_date", level: float = LEVEL) -> DataFrame:
    """Engle-Granger: unit-root test of the stage-one residuals with two-variable tables."""
    resid = cointegration_residuals(pairs, keys, order)
    out = adf_screen(resid, "residual", keys, order, trend="n", n_vars=2)
    return out.withColumn("is_cointegrated", F.col("p_value") < level).drop("is_stationary")


# --- ARMA on returns
LONG_AR = 12
ARMA_CHUNK, ARMA_BLOCK = 65_536, 256
_ARMA = T.StructType(
    [T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("const", T.DoubleType()), T.StructField("phi", T.ArrayType(T.DoubleType())),
     T.StructField("theta", T.ArrayType(T.DoubleType())), T.StructField("sigma2", T.DoubleType()), T.StructField("bic", T.DoubleType()), T.StructField("nobs", T.LongType())]
)


def _arma_solve(flat, mean: float, sd: float, max_p: int, max_q: int, long_ar: int):
    """Two-stage (Hannan-Rissanen) estimates of every order from one moment matrix; the smallest BIC wins.

    Moving-average roots outside the unit circle are reflected into it, which leaves the autocovariances as they
    are; every order competes.
    """
    m = Moments(flat, lag_names(["y"], long_ar + max_q))
    beta, _, _ = m.ols("y0", ["1", *[f"y{i}" for i in range(1, long_ar + 1)]])
    rows = {n: {n: 1.0} for n in ("1", *[f"y{i}" for i in range(max_p + 1)])}
    for j in range(1, max_q + 1):  # lagged long-AR residuals are linear in the lagged values
        rows[f"e{j}"] = {"1": -beta[0], f"y{j}": 1.0} | {f"y{j + i}": -beta[i] for i in range(1, long_ar + 1)}
    m = m.mix(rows)
    best = None
    for p, q in itertools.product(range(max_p + 1), range(max_q + 1)):
        if p == q == 0:
            continue
        x = ["1", *[f"y{i}" for i in range(1, p + 1)], *[f"e{j}" for j in range(1, q + 1)]]
        try:
            b, ssr, _ = m.ols("y0", x)
        except np.linalg.LinAlgError:
            continue
        phi, theta = b[1 : 1 + p], b[1 + p :]
        theta = _invertible(theta)
        bic = m.n * np.log(ssr / m.n) + np.log(m.n) * (p + q + 2)
        if best is None or bic < best[0]:
            const = mean * (1 - phi.sum()) + sd * b[0]
            best = (bic, p, q, const, phi, theta, ssr / m.n * sd * sd)
    return best, m.n


def arma_order_select(
    df: DataFrame, ret: str, keys: Sequence[str] = KEYS, segment: str | None = None, n_segments: int = 1, max_p: int = 3, max_q: int = 3,
    long_ar: int = LONG_AR, size: int | None = None,
) -> DataFrame:
    """ARMA order and parameters per key, or per nested training segment of every key; default AR(1)."""
    keys = list(keys)
    rows = df.filter(F.col(ret).isNotNull()).select(*keys, F.col(IDX).alias("_o"), F.col(ret).alias("y"), *([segment] if segment else []))
    rows = cut_lineage(row_index(rows, keys, "_o").drop("_o"))
    z = standardise(rows, ["y"], keys)
    m = lag_moments(z, ["z_y"], long_ar + max_q, keys, segment=segment, n_segments=n_segments, size=size)
    one = equi(m, z.groupBy(*keys).agg(F.first("mean_y").alias("mean"), F.first("sd_y").alias("sd")), keys)

    @F.pandas_udf(_ARMA)
    def solve(moments: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.DataFrame:
        out = []
        for g, mu, s in zip(moments, mean, sd):
            best = None
            try:
                best, n = _arma_solve(g, mu, s, max_p, max_q, long_ar)
            except np.linalg.LinAlgError:
                n = g[0]
            if best is None:
                out.append([1, 0, mu, [0.0], [], s * s, None, int(round(n))])
            else:
                bic, p, q, const, phi, theta, sigma2 = best
                out.append([p, q, const, phi, theta, sigma2, bic, int(round(n))])
        return pd.DataFrame(out, columns=_ARMA.fieldNames())

    return one.withColumn("_s", solve("moments", "mean", "sd")).select(*keys, *(["segment"] if segment else []), "_s.*")


def _invertible(theta: np.ndarray) -> np.ndarray:
    roots = np.roots(np.concatenate([[1.0], theta])) if len(theta) else np.zeros(0)
    outside = np.abs(roots) > 1.0
    if not outside.any():
        return theta
    roots[outside] = 1.0 / np.conj(roots[outside])
    full = np.zeros(len(theta))
    poly = np.real(np.poly(roots))[1:]
    full[: len(poly)] = poly
    return full


def _companion(theta: np.ndarray) -> np.ndarray:
    """State matrix of e[t] = u[t] - sum theta_j e[t-j] for the state (e[t], e[t-1], ...)."""
    q = len(theta)
    m = np.eye(q, k=-1)
    m[0] = -theta
    return m


def _driven(y: np.ndarray, first: int, const: float, phi: np.ndarray) -> np.ndarray:
    """y - const - sum phi_i y[t-i]; zero on the first rows of a series. `first` is the position of y[0] in it."""
    u = y - const
    for i, f in enumerate(phi, 1):
        u[i:] -= f * y[:-i]
    u[: max(0, len(phi) - first)] = 0.0
    return u


def _innovations(u: np.ndarray, theta: np.ndarray, before: np.ndarray) -> np.ndarray:
    """e[t] = u[t] - sum theta_j e[t-j] with `before` = (e[-1], e[-2], ...): exact, block by block."""
    q = len(theta)
    if q == 0:
        return u
    m, state = _companion(theta), np.asarray(before, dtype=float)
    # rows of `free`: what the incoming state adds to each row of a block; `pulse`: the response to one unit
    free, power = np.empty((ARMA_BLOCK, q)), np.eye(q)
    for t in range(ARMA_BLOCK):
        power = m @ power
        free[t] = power[0]
    pulse = np.concatenate([[1.0], free[:-1, 0]])
    out = np.empty(len(u))
    for a in range(0, len(u), ARMA_BLOCK):
        block = u[a : a + ARMA_BLOCK]
        e = np.convolve(block, pulse[: len(block)])[: len(block)] + free[: len(block)] @ state
        out[a : a + len(block)] = e
        state = np.concatenate([e[::-1], state])[:q]
    return out


def rolling_arma_forecast(
    rows: DataFrame, params: DataFrame, ret: str = "ret_1d", keys: Sequence[str] = KEYS, fold: str = "fold", size: int | None = None
) -> DataFrame:
    """One-step forecasts with parameters fixed per (key, fold), absorbing every actual.

    `rows` holds the whole history with `fold` set on rows to score (NULL elsewhere). The forecast on a
    row is for the next row. The innovations are a linear recursion over the whole history: each chunk reports
    its affine map of the last q innovations, a scan over chunk rows hands every chunk its state, and the
    chunks then run independently, exactly, whatever the roots.
    """
    keys, size = list(keys), size or ARMA_CHUNK
    packed = params.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("segment").alias("fold"), "const", "phi", "theta")).alias("_params")  # one entry per fold
    )
    depth = max(1, params.agg(F.max(F.size("phi"))).first()[0] or 1)
    work = cut_lineage(attach(rows, packed, keys, "left").filter("_params IS NOT NULL"))
    fields = [rows.schema[k] for k in keys]
    piece = T.StructType([*fields, T.StructField("_f", T.LongType()), T.StructField(CHUNK, T.LongType()), T.StructField("_map", T.ArrayType(T.DoubleType())), T.StructField("_end", T.ArrayType(T.DoubleType()))])
    start = T.StructType([*fields, T.StructField("_f", T.LongType()), T.StructField(CHUNK, T.LongType()), T.StructField("_in", T.ArrayType(T.DoubleType()))])

    def parts(pdf: pd.DataFrame):
        """Of the chunk's own rows and each fold: parameters and driven values."""
        y, at, mine = np.nan_to_num(pdf[ret].to_numpy(dtype=float)), int(pdf[IDX].iloc[0]), pdf["_owned"].to_numpy()
        for p in pdf["_params"].iloc[0]:
            phi, theta = np.asarray(p["phi"], dtype=float), np.asarray(p["theta"], dtype=float)
            yield p, phi, theta, _driven(y.copy(), at, p["const"], phi)[mine]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        own, out = pdf[pdf["_owned"]], []
        if len(own):
            key, chunk = [own[k].iloc[0] for k in keys], int(own[IDX].iloc[0]) // size
            for p, _, theta, u in parts(pdf):
                q = len(theta)
                e = _innovations(u, theta, np.zeros(q)) if q else u[:0]
                end = np.concatenate([e[::-1], np.zeros(q)])[:q]
                out.append([*key, int(p["fold"]), chunk, np.linalg.matrix_power(_companion(theta), len(own)).ravel() if q else [], end])
        return pd.DataFrame(out, columns=piece.fieldNames())

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK, ignore_index=True)
        state, incoming = np.zeros(len(pdf["_end"].iloc[0])), []
        for m, end in zip(pdf["_map"], pdf["_end"]):
            incoming.append(state)
            state = np.asarray(m).reshape(len(state), -1) @ state + np.asarray(end) if len(state) else state
        return pdf.assign(_in=incoming)[start.fieldNames()]

    pieces = mapped(work, summarise, piece, back=depth, keys=keys, size=size)
    # one row per fold and chunk of a series
    carried = pieces.groupBy(*keys, "_f").applyInPandas(scan, start).groupBy(*keys, CHUNK).agg(F.collect_list(F.struct("_f", "_in")).alias("_carry"))
    ready = equi(haloed(work, size, depth).withColumn("_owned", owned(size)), carried, [*keys, CHUNK])
    schema = T.StructType([*rows.schema.fields, T.StructField("arma_forecast", T.DoubleType())])
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        own = pdf["_owned"].to_numpy()
        fold_of = pdf[fold].to_numpy(dtype=float)
        out, y, before = np.full(len(pdf), np.nan), np.nan_to_num(pdf[ret].to_numpy(dtype=float)), int((~own).sum())
        carry = {int(c["_f"]): np.asarray(c["_in"], dtype=float) for c in pdf["_carry"].iloc[0]}
        for p, phi, theta, u in parts(pdf):
            at = np.flatnonzero(own & (fold_of == p["fold"]))
            if not len(at):
                continue
            step = np.full(len(at), p["const"])
            for i, w in enumerate(phi):
                step += w * np.where(at >= i, y[at - i], 0.0)
            if len(theta):
                state = carry[int(p["fold"])]
                e = np.concatenate([state[::-1], _innovations(u, theta, state)])
                for j, w in enumerate(theta):
                    step += w * e[at - before - j + len(state)]
            out[at] = step
        return pdf.assign(arma_forecast=out).loc[own & ~np.isnan(fold_of), names]

    return ready.groupBy(*keys, CHUNK).applyInPandas(run, schema)


def fixed_ar_forecast(w, ret: str, const: float, phi: Sequence[float]) -> Column:
    """Pure AR with given parameters as window lags: the forecast of the next value."""
    out = F.lit(float(const))
    for i, p in enumerate(phi):
        out = out + float(p) * (F.lag(ret, i).over(w) if i else F.col(ret))
    return out


def latest_arma_forecast(df: DataFrame, ret: str = "ret_1d", keys: Sequence[str] = KEYS, min_obs: int = 60, size: int | None = None) -> DataFrame:
    """Refit on all history, forecast one step; NULL for short series."""
    keys = list(keys)
    whole = df.filter(F.col(ret).isNotNull()).withColumn("_seg", F.lit(1))
    params = arma_order_select(whole, ret, keys, "_seg", 1)
    n = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_returns"), F.max(IDX).alias("_last"))
    marked = attach(whole.drop("_seg"), n, keys).withColumn("fold", F.when(F.col(IDX) == F.col("_last"), F.lit(1)))
    ordered = row_index(marked.select(*keys, F.col(IDX).alias("_o"), ret, "fold"), keys, "_o").drop("_o")
    scored = rolling_arma_forecast(ordered, params, ret, keys, size=size).select(*keys, "arma_forecast")
    out = equi(equi(n, params.drop("segment"), keys, "left"), scored, keys, "left")
    return out.withColumn("arma_forecast", F.when(F.col("n_returns") >= min_obs, F.col("arma_forecast"))).drop("_last")
