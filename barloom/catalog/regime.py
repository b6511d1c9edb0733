"""Regime model: fits, causal filters and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import FOLDS, RETURNS, over, panel, query, rounded
from barloom.operators import features as ft, folds, regime
from barloom.plans.panel import windowed

KEY = ("series_id", "bar_date")
OBS = ("ret_1d", "vol_10d")
# Pinned parameters, so that SQL can repeat the recursion: start, transitions, means, variances.
PINNED = ((0.5, 0.5), (0.95, 0.05, 0.1, 0.9), (0.0, 1.0, 1.0, 6.0), (1.0, 1.0, 16.0, 36.0))


def observations(spark, sf):
    df = windowed(
        panel(spark, sf), lambda d, w: (lambda e: e.withColumn("vol_10d", ft.realised_vol("ret_1d", w, 10)))(d.withColumn("ret_1d", ft.pct_change("close", w))), back=11
    )
    return df.select(*KEY, "row_idx", "n_rows", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in OBS])


def pinned(df):
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    names = [f.name for f in regime.PARAM_FIELDS]
    """One parameter row per series of `df`."""
    return df.select("series_id").distinct().select("series_id", *[arr(v).alias(n) for v, n in zip(PINNED, names)])


def train_params(spark, sf):
    """Fits on train and validation rows of every fold."""
    ex = folds.expand_folds(observations(spark, sf)).filter("role <> 'test'")
    return regime.hmm_fit(ex, OBS, ["series_id", "fold"])


@query("hmm_fit")
def _(spark, sf):
    return regime.high_vol_state(train_params(spark, sf))


_PI, _T, _MU, _V = PINNED
_B = lambda s: " - ".join(
    [f"-0.5::DOUBLE * (ln(2 * pi() * {_V[2 * s]}) + (ret_1d - {_MU[2 * s]}) * (ret_1d - {_MU[2 * s]}) / {_V[2 * s]}::DOUBLE)",
     f"0.5::DOUBLE * (ln(2 * pi() * {_V[2 * s + 1]}) + (vol_10d - {_MU[2 * s + 1]}) * (vol_10d - {_MU[2 * s + 1]}) / {_V[2 * s + 1]}::DOUBLE)"]
)
_OBS_SQL = f"""{RETURNS.replace('bars AS (', 'bars AS MATERIALIZED (', 1)}, ob AS (SELECT series_id, bar_date, row_idx, coalesce(ret_1d, 0) AS ret_1d,
    coalesce(CASE WHEN {over('count(ret_1d)', 10)} = 10 THEN {over('stddev_samp(ret_1d)', 10)} END, 0) AS vol_10d FROM rets),
  em AS MATERIALIZED (SELECT series_id, bar_date, row_idx, {_B(0)} AS l0, {_B(1)} AS l1 FROM ob),
  eb AS MATERIALIZED (SELECT series_id, bar_date, row_idx, exp(l0 - greatest(l0, l1)) AS b0, exp(l1 - greatest(l0, l1)) AS b1 FROM em),
  f AS (SELECT series_id, row_idx, {_PI[0]} * b0 / ({_PI[0]} * b0 + {_PI[1]} * b1) AS p0 FROM eb WHERE row_idx = 0
    UNION ALL
    SELECT e.series_id, e.row_idx, (f.p0 * {_T[0]} + (1 - f.p0) * {_T[2]}) * b0 / ((f.p0 * {_T[0]} + (1 - f.p0) * {_T[2]}) * b0 + (f.p0 * {_T[1]} + (1 - f.p0) * {_T[3]}) * b1)
    FROM f JOIN eb e ON e.series_id = f.series_id AND e.row_idx = f.row_idx + 1)"""


@query("hmm_filter", f"WITH RECURSIVE {_OBS_SQL} SELECT series_id, bar_date, round(p0, 6) AS p_state0, round(1 - p0, 6) AS p_state1 FROM f JOIN eb USING (series_id, row_idx)")
def _(spark, sf):
    df = observations(spark, sf)
    out = regime.hmm_filter(df, pinned(df), OBS, size=1024)
    return rounded(out.select(*KEY, F.col("filtered")[0].alias("p_state0"), F.col("filtered")[1].alias("p_state1")), 6)


@query("high_vol_probability", f"WITH RECURSIVE {_OBS_SQL} SELECT series_id, bar_date, round(1 - p0, 6) AS regime_high_vol_prob FROM f JOIN eb USING (series_id, row_idx)")
def _(spark, sf):
    df = observations(spark, sf)
    return rounded(regime.high_vol_probability(df, pinned(df), OBS).select(*KEY, "regime_high_vol_prob"), 6)


@query("high_vol_state", "WITH s AS (SELECT DISTINCT o_orderpriority AS series_id FROM orders) SELECT series_id, 1 AS high_vol_state FROM s")
def _(spark, sf):
    return regime.high_vol_state(pinned(observations(spark, sf))).select("series_id", "high_vol_state")


@query("fold_regime_probability")
def _(spark, sf):
    """Per fold: fit on its training part, filter over all its rows."""
    ex = folds.expand_folds(observations(spark, sf))
    params = regime.hmm_fit(ex.filter("role <> 'test'"), OBS, ["series_id", "fold"])
    out = regime.high_vol_probability(ex.select("series_id", "fold", "bar_date", "row_idx", "role", *OBS), params, OBS, ["series_id", "fold"])
    return out.select("series_id", "fold", "bar_date", "role", "regime_high_vol_prob")


@query("hmm_smooth", f"""WITH RECURSIVE {_OBS_SQL}, ends AS (SELECT series_id, max(row_idx) AS last FROM eb GROUP BY 1),
  b AS (SELECT series_id, last AS row_idx, 0.5::DOUBLE AS q0 FROM ends
    UNION ALL SELECT series_id, row_idx - 1, u0 / (u0 + u1) FROM (SELECT b.series_id, b.row_idx, {_T[0]} * e.b0 * b.q0 + {_T[1]} * e.b1 * (1 - b.q0) AS u0, {_T[2]} * e.b0 * b.q0 + {_T[3]} * e.b1 * (1 - b.q0) AS u1
      FROM b JOIN eb e USING (series_id, row_idx) WHERE b.row_idx > 0))
  SELECT series_id, bar_date, round((1 - p0) * (1 - q0) / (p0 * q0 + (1 - p0) * (1 - q0)), 6) AS noncausal_p_state1 FROM f JOIN b USING (series_id, row_idx) JOIN eb USING (series_id, row_idx)""")
def _(spark, sf):
    df = observations(spark, sf)
    return rounded(regime.hmm_smooth(df, pinned(df), OBS, size=1024).select(*KEY, F.col("noncausal_smoothed")[1].alias("noncausal_p_state1")), 6)


@query("hmm_viterbi", f"""WITH RECURSIVE {_OBS_SQL}, v AS (SELECT series_id, row_idx, ln({_PI[0]}) + l0 AS d0, ln({_PI[1]}) + l1 AS d1, 0 AS k0, 0 AS k1 FROM em WHERE row_idx = 0
    UNION ALL SELECT e.series_id, e.row_idx, greatest(v.d0 + ln({_T[0]}), v.d1 + ln({_T[2]})) + l0, greatest(v.d0 + ln({_T[1]}), v.d1 + ln({_T[3]})) + l1,
      CASE WHEN v.d1 + ln({_T[2]}) > v.d0 + ln({_T[0]}) THEN 1 ELSE 0 END, CASE WHEN v.d1 + ln({_T[3]}) > v.d0 + ln({_T[1]}) THEN 1 ELSE 0 END
    FROM v JOIN em e ON e.series_id = v.series_id AND e.row_idx = v.row_idx + 1),
  ends AS (SELECT series_id, max(row_idx) AS last FROM em GROUP BY 1),
  s AS (SELECT v.series_id, v.row_idx, CASE WHEN d1 > d0 THEN 1 ELSE 0 END AS state FROM v JOIN ends ON v.series_id = ends.series_id AND v.row_idx = ends.last
    UNION ALL SELECT s.series_id, s.row_idx - 1, CASE WHEN s.state = 0 THEN v.k0 ELSE v.k1 END FROM s JOIN v USING (series_id, row_idx) WHERE s.row_idx > 0)
  SELECT series_id, bar_date, state AS noncausal_state FROM s JOIN em USING (series_id, row_idx)""")
def _(spark, sf):
    df = observations(spark, sf)
    return regime.hmm_viterbi(df, pinned(df), OBS, size=1024).select(*KEY, "noncausal_state")


@query("fold_regime_feature", f"""WITH RECURSIVE {RETURNS.replace('bars AS (', 'bars AS MATERIALIZED (', 1)}, {FOLDS}, ob AS (SELECT series_id, bar_date, row_idx, coalesce(ret_1d, 0) AS x FROM rets),
  pr AS (SELECT f.series_id, f.fold, any_value(f.test_end) AS test_end, avg(x) AS m, var_pop(x) AS v FROM ob JOIN folds f ON f.series_id = ob.series_id AND row_idx < f.test_start GROUP BY 1, 2),
  em AS (SELECT ob.series_id, fold, bar_date, row_idx, -0.5::DOUBLE * (ln(2 * pi() * v) + (x - m) * (x - m) / v) AS l0, -0.5::DOUBLE * (ln(2 * pi() * 9 * v) + (x - m) * (x - m) / (9 * v)) AS l1 FROM ob JOIN pr ON pr.series_id = ob.series_id AND row_idx < test_end),
  eb AS MATERIALIZED (SELECT *, exp(l0 - greatest(l0, l1)) AS b0, exp(l1 - greatest(l0, l1)) AS b1 FROM em),
  f AS (SELECT series_id, fold, row_idx, 0.5 * b0 / (0.5 * b0 + 0.5 * b1) AS p0 FROM eb WHERE row_idx = 0
    UNION ALL SELECT e.series_id, e.fold, e.row_idx, (f.p0 * 0.95 + (1 - f.p0) * 0.1) * b0 / ((f.p0 * 0.95 + (1 - f.p0) * 0.1) * b0 + (f.p0 * 0.05 + (1 - f.p0) * 0.9) * b1)
    FROM f JOIN eb e ON e.series_id = f.series_id AND e.fold = f.fold AND e.row_idx = f.row_idx + 1)
  SELECT series_id, fold, bar_date, round(1 - p0, 6) AS regime_high_vol_prob FROM f JOIN eb USING (series_id, fold, row_idx)""")
def _(spark, sf):
    """Filtered per fold with the mean and variance of that fold's own training rows; the second state is three times as wide."""
    df = observations(spark, sf).select(*KEY, "row_idx", "n_rows", "ret_1d")
    arr = lambda *v: F.array(*[F.lit(x) if isinstance(x, float) else x for x in v])
    seen = folds.expand_folds(df).filter("role <> 'test'").groupBy("series_id", "fold").agg(F.avg("ret_1d").alias("m"), F.var_pop("ret_1d").alias("v"))
    params = seen.select("series_id", "fold", arr(0.5, 0.5).alias("start"), arr(0.95, 0.05, 0.1, 0.9).alias("trans"), arr(F.col("m"), F.col("m")).alias("means"), arr(F.col("v"), 9 * F.col("v")).alias("vars"))
    out = regime.fold_regime_feature(df, ["ret_1d"], params, size=512)
    return rounded(out.select("series_id", "fold", "bar_date", "regime_high_vol_prob"), 6)
