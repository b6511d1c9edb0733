"""The walk-forward report, and serving inputs built like training inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import folds, learned, report
from barloom.plans.panel import row_index


def test_report_has_every_part(spark):
    rng = np.random.default_rng(2)
    rows = [(s, k, i, float(a), float(a + 0.5 * e), float(0.3 * a + g), 0.0, float(u)) for s in "AB" for k in (1, 2) for i, (a, e, g, u) in enumerate(rng.normal(size=(40, 4)) * 0.01)]
    rows.append(("A", 1, 99, 0.01, None, 0.0, 0.0, 0.5))  # without a forecast: left out of every model's score
    scored = spark.createDataFrame(rows, "series_id string, fold int, i int, actual double, hybrid double, arima double, persistence double, alpha double")
    draws = F.explode(F.array(*[F.lit(float(z)) for z in np.linspace(-0.02, 0.02, 30)]))
    samples = scored.na.drop().select("series_id", "fold", "i", "hybrid", draws.alias("z")).select("series_id", "fold", "i", (F.col("hybrid") + F.col("z")).alias("value"))
    psi = spark.createDataFrame([("A", 1, "x", 0.3, "alert"), ("A", 1, "y", 0.1, "stable"), ("B", 2, "x", 0.2, "moderate_drift")], "series_id string, fold int, feature string, psi double, status string")
    orders = spark.createDataFrame([("A", 1, 2, 1)], "series_id string, fold int, p int, q int")
    out = report.walk_forward_report(scored, ("hybrid", "arima", "persistence"), alpha="alpha", samples=samples, row_keys=["series_id", "fold", "i"], psi=psi, orders=orders)
    got = {(r.series_id, r.fold): r for r in out.collect()}
    assert set(got) == {(s, k) for s in "AB" for k in (1, 2, None)}
    pdf = pd.DataFrame(rows, columns=scored.columns).dropna()
    for (s, k), r in got.items():
        own = pdf[(pdf.series_id == s) & ((pdf.fold == k) if k else True)]
        assert r.metrics_hybrid.n == r.metrics_persistence.n == len(own) == r.calibration.n_predictions
        assert r.metrics_arima.mse == pytest.approx(((own.actual - own.arima) ** 2).mean()) and r.gate.alpha_std == pytest.approx(own.alpha.std(ddof=0))
        d = (own.actual - own.hybrid) ** 2 - (own.actual - own.arima) ** 2
        n = len(own)
        assert r.dm_vs_arima.dm_statistic == pytest.approx(d.mean() / np.sqrt(d.var(ddof=0) / n) * np.sqrt((n - 1) / n))
        assert r.direction.n_correct == (np.sign(own.hybrid) == np.sign(own.actual)).sum() and sum(r.calibration.pit_histogram) == n
    assert got["A", 1].psi.n_alert == 1 and got["A", 1].psi.top_features == ["x", "y"] and got["A", None].psi is None
    assert (got["A", 1].order.p, got["A", 1].order.q) == (2, 1) and got["B", 1].order is None


def test_inputs_of_the_newest_row_need_only_the_last_rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"series_id": "A", "bar_date": pd.date_range("2000-01-01", periods=90).date, "close": 50 + rng.random(90), "ar_forecast": 50 + rng.random(90), "vol_21d": rng.random(90), "f": rng.normal(size=90)})
    pdf.loc[70, "f"] = np.nan
    df = row_index(spark.createDataFrame(pdf), length="n_rows")
    cols = ["f", "vol_21d"]
    scaler = folds.fit_scaler(df.filter("row_idx < 60"), cols)
    served = folds.serving_inputs(df, cols, scaler, length=20).first()
    trained = folds.model_inputs(df, cols, scaler, length=20).filter("row_idx = 89").first()
    assert served.seq == trained.seq and served.vol_inputs == trained.vol_inputs and served.ar_return == trained.ar_return
    mean, sd = pdf[:60].mean(numeric_only=True), pdf[:60].std(ddof=0, numeric_only=True)
    assert [r.f for r in served.seq] == pytest.approx(((pdf.f - mean.f) / sd.f).fillna(0.0)[69:89].tolist())
    vol = min(max((pdf.vol_21d[89] - mean.vol_21d) / sd.vol_21d, 0), 1)
    first = min(max((pdf.f[89] - mean.f) / sd.f, 0), 1)
    assert served.vol_inputs == pytest.approx([vol] + [first] * 4)
    assert folds.serving_inputs(df.filter("row_idx < 20"), cols, scaler, length=20).count() == 0


def test_a_constant_feature_is_scaled_to_zero(spark):
    """Sums of 0.2 round away from 0.2, so neither mean nor deviation may come from them."""
    df = spark.range(1931).selectExpr("'A' AS series_id", "id", "0.2D AS f", "cast(id % 7 AS double) AS g").repartition(3)
    scaler = folds.fit_scaler(df, ["f", "g"], ["series_id"])
    got = {r.feature: r for r in scaler.collect()}
    assert (got["f"].mean, got["f"].scale) == (0.2, 1.0) and got["g"].scale == pytest.approx(np.std(np.arange(1931) % 7))
    assert [r.f for r in folds.apply_scaler(df, scaler, ["f"], ["series_id"]).select("f").distinct().collect()] == [0.0]


def test_bagged_members_are_weighted_ridge_fits(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, *map(float, x), float(0.5 * x[0] - x[1] + 0.1 * rng.normal()), "train" if i < 80 else "test") for k in (1, 2) for i, x in enumerate(rng.normal(size=(90, 2)))]
    df = spark.createDataFrame(rows, "fold int, i int, a double, b double, actual double, role string").repartition(3)
    weights = {(r.fold, r.i): r.w for r in df.select("fold", "i", learned.bag_weights(["fold", "i"], 7, 1).alias("w")).collect()}
    every = np.concatenate(list(weights.values()))
    assert abs(every.mean() - 1) < 0.1 and abs(every.var() - 1) < 0.2 and every.max() >= 3
    got = {(r.fold, r.i, r.sample_id): r.value for r in learned.bagged_samples(df, ["a", "b"], ["fold", "i"], 7, 1.0, 1).collect()}
    assert len(got) == 2 * 10 * 7
    for k in (1, 2):
        train = [r for r in rows if r[0] == k and r[5] == "train"]
        x, y = np.array([[1, r[2], r[3]] for r in train]), np.array([r[4] for r in train])
        w = np.array([weights[k, r[1]] for r in train])
        for j in range(7):
            beta = np.linalg.solve((x * w[:, [j]]).T @ x + np.diag([0, 1, 1]), (x * w[:, [j]]).T @ y)
            for r in [r for r in rows if r[0] == k and r[5] == "test"]:
                assert got[k, r[1], j] == pytest.approx(beta @ [1, r[2], r[3]], rel=1e-9)
