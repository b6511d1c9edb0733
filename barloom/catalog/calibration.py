"""Predictive calibration and population-stability drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import FORECASTS, PANEL, RETURNS, SAMPLES, W, clip_sql, forecasts, over, panel, query, rounded, rsql, sample_grid
from barloom.catalog.folds import EXPANDED
from barloom.operators import calibration as cal, drift, features as ft, folds
from barloom.plans.panel import windowed
from barloom.plans.quantiles import exact_quantiles
from barloom.session import cut_lineage

ROW = ["series_id", "fold", "bar_date"]
_Q = ", ".join(f"quantile_cont(value, {a!r}::DOUBLE) AS lower_{t}, quantile_cont(value, {b!r}::DOUBLE) AS upper_{t}" for t, a, b in [(f"{round(c * 100)}", (1 - c) / 2, 1 - (1 - c) / 2) for c in cal.LEVELS])
SUMMARY = SAMPLES + f""", summ AS (SELECT series_id, fold, bar_date, any_value(actual) AS actual, count(*) AS n_samples, avg(CAST(value <= actual AS DOUBLE)) AS pit,
  stddev_pop(value) AS pred_std, {_Q} FROM samples GROUP BY ALL)"""
_NAMES = [f"{s}_{t}" for t in ("50", "80", "90") for s in ("lower", "upper")]


@query("prediction_intervals", f"WITH {SUMMARY} SELECT series_id, fold, bar_date, {rsql(8, **{c: c for c in _NAMES})} FROM summ")
def _(spark, sf):
    return rounded(cal.prediction_intervals(sample_grid(spark, sf)[0], ROW), 8)


_IN = lambda t: f"avg(CAST(actual BETWEEN lower_{t} AND upper_{t} AS DOUBLE))"


@query("empirical_coverage", f"WITH {SUMMARY} " + " UNION ALL ".join(
    f"SELECT fold, {c}::DOUBLE AS nominal, round({_IN(round(c * 100))}, 8) AS empirical, round({_IN(round(c * 100))} - {c}, 8) AS gap FROM summ GROUP BY fold" for c in cal.LEVELS))
def _(spark, sf):
    return rounded(cal.empirical_coverage(cal.sample_summary(*sample_grid(spark, sf), ROW), ["fold"]), 8, "empirical", "gap")


@query("pit_values", f"WITH {SUMMARY} SELECT series_id, fold, bar_date, round(pit, 8) AS pit FROM summ")
def _(spark, sf):
    return rounded(cal.pit_values(*sample_grid(spark, sf), ROW), 8)


_BIN = " + ".join(f"CAST(pit >= {e!r}::DOUBLE AS INT)" for e in cal.PIT_EDGES)
_HIST = f"h AS (SELECT fold, {_BIN} AS bin, count(*) AS n FROM summ GROUP BY ALL)"


@query("pit_histogram", f"WITH {SUMMARY}, {_HIST} SELECT f.fold, b.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT fold FROM summ) f CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN h ON h.fold = f.fold AND h.bin = b.bin")
def _(spark, sf):
    return cal.pit_histogram(cal.pit_values(*sample_grid(spark, sf), ROW), ["fold"])


_KS = """ks AS (SELECT fold, max(greatest(i / n - pit, pit - (i - 1) / n)) AS d, max(n) AS n FROM (SELECT fold, pit, CAST(row_number() OVER (PARTITION BY fold ORDER BY pit) AS DOUBLE) AS i,
  count(*) OVER (PARTITION BY fold) AS n FROM summ) GROUP BY 1)"""


@query("ks_uniform_statistic", f"WITH {SUMMARY}, {_KS} SELECT fold, n, round(d, 8) AS ks_statistic FROM ks")
def _(spark, sf):
    return rounded(cal.ks_uniform_statistic(cal.pit_values(*sample_grid(spark, sf), ROW), ["fold"]), 8)


@query("ks_uniform_test", f"""WITH {SUMMARY}, {_KS}, l AS (SELECT fold, n, d, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * d AS l FROM ks)
  SELECT fold, n, {rsql(8, ks_statistic='d')}, round(CASE WHEN l < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * l * l))))) END, 6) AS ks_pvalue FROM l""")
def _(spark, sf):
    return rounded(rounded(cal.ks_uniform(cal.pit_values(*sample_grid(spark, sf), ROW), ["fold"]), 8, "ks_statistic"), 6, "ks_pvalue")


@query("calibration_report", f"""WITH {SUMMARY}, {_KS}, r AS (SELECT fold, count(*) AS n_predictions, max(n_samples) AS n_samples, {', '.join(f'round({_IN(t)}, 8) AS coverage_{t}' for t in (50, 80, 90))},
    {', '.join(f'count(*) FILTER (({_BIN}) = {b}) AS bin_{b}' for b in range(10))}, round(avg(pred_std), 8) AS pred_std_mean FROM summ GROUP BY 1)
  SELECT r.*, round(ks.d, 8) AS ks_statistic FROM r JOIN ks USING (fold)""")
def _(spark, sf):
    rep = cal.calibration_report(*sample_grid(spark, sf), ROW, ["fold"], with_p=False)
    return rounded(rep.select("*", *[F.col("pit_histogram")[b].alias(f"bin_{b}") for b in range(10)]).drop("pit_histogram"), 8)


# --- exact quantiles and drift
_P = [i / 10 for i in range(11)]


@query("exact_quantiles", f"WITH {PANEL} SELECT series_id, {', '.join(f'round(quantile_cont(close, {p}), 6) AS q{i}' for i, p in enumerate(_P))} FROM panel GROUP BY 1")
def _(spark, sf):
    q = exact_quantiles(panel(spark, sf), ["series_id"], "close", _P)
    return rounded(q.select("series_id", *[F.col("quantiles")[i].alias(f"q{i}") for i in range(11)]), 6)


_VARS = ("ret_1d", "ret_5d", "vol_10d", "sma20_ratio", "intraday_range", "dow", "is_month_end")
_smar = f"CASE WHEN {over('count(close)', 20)} = 20 THEN close / {over('avg(close)', 20)} - 1 END"
_VSQL = {
    "ret_1d": "ret_1d", "ret_5d": f"close / {over('lag(close, 5)')} - 1", "vol_10d": f"CASE WHEN {over('count(ret_1d)', 10)} = 10 THEN {over('stddev_samp(ret_1d)', 10)} END",
    "sma20_ratio": clip_sql(_smar, -0.5, 0.5), "intraday_range": clip_sql("(high - low) / close", 0, 0.2), "dow": "(isodow(bar_date) - 1) / 4.0",
    "is_month_end": "CAST(bar_date = last_day(bar_date) AS DOUBLE)",
}
# both sides rounded to 9 digits so that ties between engines fall in the same bucket
_LONG = f"""{RETURNS}, {EXPANDED}, fv AS (SELECT series_id, row_idx, {', '.join(f'round({e}, 9) AS {n}' for n, e in _VSQL.items())} FROM rets),
  lg AS (SELECT e.fold, e.role = 'train' AS is_reference, u.feature, u.value FROM ex e JOIN
    (SELECT * FROM fv UNPIVOT (value FOR feature IN ({', '.join(_VSQL)}))) u ON u.series_id = e.series_id AND u.row_idx = e.row_idx WHERE e.role <> 'val'),
  q AS (SELECT fold, feature, list_distinct(quantile_cont(value, {_P})) AS e, min(value) AS mn, max(value) AS mx FROM lg WHERE is_reference GROUP BY 1, 2),
  edges AS (SELECT fold, feature, CASE WHEN len(e) >= 3 THEN list_sort(e)[2:len(e) - 1] ELSE [mn, mx] END AS inner_edges FROM q)"""


def fold_features(spark, sf):
    """fold, is_reference and the features over the train and test rows of every fold."""

    def build(d, w):
        d = d.withColumn("ret_1d", ft.pct_change("close", w))
        return d.withColumns(
            {"ret_5d": ft.pct_change("close", w, 5), "vol_10d": ft.realised_vol("ret_1d", w, 10), "sma20_ratio": ft.sma_ratio("close", w, 20),
             "intraday_range": ft.intraday_range(), **ft.calendar()}
        )

    df = windowed(panel(spark, sf), build, back=21)
    df = cut_lineage(rounded(df, 9, *_VARS).select("series_id", "row_idx", "n_rows", *_VARS))  # features once, read per pass
    return folds.expand_folds(df).filter("role <> 'val'").withColumn("is_reference", F.col("role") == "train")


def feature_long(spark, sf):
    return drift.long_features(fold_features(spark, sf), ["fold", "is_reference"], _VARS)


@query("psi_edges", f"WITH {_LONG}, x AS (SELECT fold, feature, unnest(inner_edges) AS edge, generate_subscripts(inner_edges, 1) - 1 AS pos FROM edges) SELECT fold, feature, pos, round(edge, 10) AS edge FROM x")
def _(spark, sf):
    e = drift.psi_edges(feature_long(spark, sf).filter("is_reference"), ["fold", "feature"])
    return rounded(e.select("fold", "feature", F.posexplode("inner_edges").alias("pos", "edge")).withColumn("pos", F.col("pos").cast("long")), 10)


_PSI = _LONG + """, bk AS (SELECT l.fold, l.feature, l.is_reference, len(list_filter(e.inner_edges, lambda x: x <= l.value)) AS bucket, any_value(len(e.inner_edges)) AS last, count(*) AS n
    FROM lg l JOIN edges e USING (fold, feature) GROUP BY ALL),
  al AS (SELECT e.fold, e.feature, unnest(range(len(e.inner_edges) + 1)) AS bucket FROM edges e),
  ct AS (SELECT al.*, coalesce(r.n, 0) AS rn, coalesce(c.n, 0) AS cn FROM al LEFT JOIN bk r ON r.fold = al.fold AND r.feature = al.feature AND r.bucket = al.bucket AND r.is_reference
    LEFT JOIN bk c ON c.fold = al.fold AND c.feature = al.feature AND c.bucket = al.bucket AND NOT c.is_reference),
  p1 AS (SELECT *, greatest(rn / sum(rn) OVER k, 1e-4) AS p, greatest(cn / sum(cn) OVER k, 1e-4) AS q FROM ct WINDOW k AS (PARTITION BY fold, feature)),
  p2 AS (SELECT *, p / sum(p) OVER k AS pn, q / sum(q) OVER k AS qn FROM p1 WINDOW k AS (PARTITION BY fold, feature)),
  psi AS (SELECT fold, feature, sum((qn - pn) * ln(qn / pn)) AS psi, CAST(sum(rn) AS BIGINT) AS n_reference, CAST(sum(cn) AS BIGINT) AS n_current, count(*) AS n_buckets, count(*) FILTER (cn > 0) = 1 AS is_saturated FROM p2 GROUP BY 1, 2),
  rep AS (SELECT *, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'moderate_drift' ELSE 'stable' END AS status FROM psi)"""


@query("psi", f"WITH {_PSI} SELECT fold, feature, round(psi, 8) AS psi, n_reference, n_current, n_buckets, is_saturated FROM psi")
def _(spark, sf):
    return rounded(drift.psi_features(fold_features(spark, sf), ["fold"], _VARS), 8)


@query("psi_report", f"WITH {_PSI} SELECT fold, feature, round(psi, 8) AS psi, status FROM rep")
def _(spark, sf):
    return rounded(drift.psi_report(feature_long(spark, sf), ["fold", "feature"]).select("fold", "feature", "psi", "status"), 8)


@query("psi_summary", f"""WITH {_PSI}, rk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY psi DESC, feature) AS k FROM rep)
  SELECT fold, count(*) FILTER (status = 'alert') AS n_alert, count(*) FILTER (status = 'moderate_drift') AS n_moderate, round(max(psi), 8) AS psi_max,
    string_agg(feature, ',' ORDER BY k) FILTER (k <= 5) AS top_features FROM rk GROUP BY 1""")
def _(spark, sf):
    report = drift.ranked_report(drift.psi_features(fold_features(spark, sf), ["fold"], _VARS), ["fold", "feature"])
    s = drift.psi_summary(report, ["fold"])
    return rounded(s.withColumn("top_features", F.array_join("top_features", ",")), 8)
