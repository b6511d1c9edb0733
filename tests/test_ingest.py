"""Incremental ingest, file sources and streaming over several micro-batches."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import clean, joins
from barloom.operators.blend import forecast_response, select_primary, signal_label
from barloom.operators.regime import Params
from barloom.sources import bars as src, news
from barloom.streaming import bars as st


def epoch(day, hour=14):
    return int(dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc).timestamp()) + hour * 3600


def payload(days, closes, offset=-14400, **over):
    q = {c: list(closes) for c in ("open", "high", "low", "close", "volume")} | over
    return json.dumps({"timestamp": [epoch(d) for d in days], "meta": {"gmtoffset": offset}, "indicators": {"quote": [q]}})


def parsed(spark, body, now, after=None):
    df = spark.createDataFrame([("S", body)], "series_id string, payload string")
    out = src.parse_chart_bars(df, F.lit(now).cast("timestamp"), F.lit(after).cast("date") if after else None)
    return [(str(r.bar_date), r.close) for r in out.orderBy("bar_date").collect()]


def test_chart_bars(spark):
    days = ["2024-03-04", "2024-03-05", "2024-03-06"]
    assert parsed(spark, payload(days, [1.0, None, 3.0]), "2024-03-10 12:00:00") == [("2024-03-04", 1.0), ("2024-03-06", 3.0)]
    assert parsed(spark, payload(days, [1.0, 2.0, 3.0]), "2024-03-06 20:00:00") == [("2024-03-04", 1.0), ("2024-03-05", 2.0)]  # 15:00 New York
    assert len(parsed(spark, payload(days, [1.0, 2.0, 3.0]), "2024-03-06 21:30:00")) == 3  # 16:30 New York
    assert parsed(spark, payload(days, [1.0, 2.0, 3.0]), "2024-03-10 12:00:00", after="2024-03-05") == [("2024-03-06", 3.0)]
    assert parsed(spark, payload(["2024-03-04", "2024-03-04"], [1.0, 9.0]), "2024-03-10 12:00:00") == [("2024-03-04", 9.0)]
    assert parsed(spark, json.dumps({"timestamp": [], "meta": {}, "indicators": {"quote": []}}), "2024-03-10 12:00:00") == []


def test_append_is_idempotent(spark, bars):
    old, new = bars.filter("bar_date < DATE '2019-01-01'"), bars.filter("bar_date >= DATE '2018-06-01'").withColumn("close", F.col("close") + 1)
    once = src.append_since_high_water(old, new)
    twice = src.append_since_high_water(once, new)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()
    assert old.exceptAll(once).isEmpty()  # history is never rewritten


def test_failed_macro_is_named_and_filled(spark):
    macro = "name string, obs_date string, value double"
    old = spark.createDataFrame([("VIX", "2024-01-01", 1.0), ("TNX", "2024-01-01", 5.0)], macro).withColumn("obs_date", F.to_date("obs_date"))
    new = spark.createDataFrame([("VIX", "2024-01-02", 2.0)], macro).withColumn("obs_date", F.to_date("obs_date"))
    rows = src.extend_macro(old, new, ["VIX", "TNX"]).orderBy("obs_date").collect()
    assert [tuple(r)[1:] for r in rows] == [(1.0, 5.0), (2.0, 5.0)]
    assert [r.name for r in src.macro_errors(old, new).collect()] == ["TNX"]


def test_csv_headers_and_errors(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Trade DATE,OPEN,High,low,Close,Volume,Extra\n2020-01-02 00:00:00-05:00,1,2,0.5,1.5,10,x\n2020-01-03,1,,0.5,1.5,10,x\n2020-01-06,1,2,0.5,1.7,11,x\n")
    got = src.read_bars_csv(spark, [str(tmp_path / "none.csv"), str(p)], "2020-01-01", "2020-01-31")
    assert [(str(r.bar_date), r.close) for r in got.orderBy("bar_date").collect()] == [("2020-01-02", 1.5), ("2020-01-06", 1.7)]
    with pytest.raises(ValueError, match="no date column"):
        src.read_bars_csv(spark, str(p), strict=True)
    q = tmp_path / "b.csv"
    q.write_text("Date,Open,Close\n2020-01-02,1,2\n")
    with pytest.raises(ValueError, match="missing required"):
        src.read_bars_csv(spark, str(q), strict=True)
    with pytest.raises(FileNotFoundError):
        src.read_bars_csv(spark, str(tmp_path / "none.csv"))


def test_cleaning(spark):
    df = spark.createDataFrame(
        [("a", "2020-01-01", 1.0, 2.0, 3.0, 1.0, -5.0), ("a", "2020-01-02", None, None, None, None, None), ("a", "2020-01-03", None, 5.0, 1.0, 2.0, 7.0)],
        "series_id string, d string, open double, high double, low double, close double, volume double",
    ).withColumn("bar_date", F.to_date("d")).drop("d")
    rows = clean.validate_and_clean(df).orderBy("bar_date").collect()
    assert [(r.open, r.high, r.volume) for r in rows] == [(1.0, 3.0, 0.0), (1.0, 5.0, 7.0)]
    with pytest.raises(ValueError, match="nope"):
        clean.require_features(df, ["close", "nope"])


def test_next_session_skips_weekends(spark):
    df = spark.createDataFrame([("2024-03-07",), ("2024-03-08",), ("2024-03-09",), ("2024-03-10",)], "d string")
    assert [str(r[0]) for r in df.select(clean.next_session(F.to_date("d"))).collect()] == ["2024-03-08", "2024-03-11", "2024-03-11", "2024-03-11"]


def test_misaligned_forecasts_fail(spark):
    a = spark.createDataFrame([(1, 0.1, 1.0)], "t int, pred double, actual double")
    ok = joins.align_forecasts({"x": a, "y": a}, ["t"])
    assert joins.require_aligned(ok).count() == 1
    bad = joins.align_forecasts({"x": a, "y": a.withColumn("actual", F.lit(1.1))}, ["t"])
    with pytest.raises(Exception, match="different targets"):
        joins.require_aligned(bad).collect()


def test_response(spark):
    latest = spark.createDataFrame([("s", dt.date(2024, 3, 8), 100.0, None, 0.01, 0.4), ("r", dt.date(2024, 3, 7), 50.0, -0.001, 0.5, 0.4)],
                                   "series_id string, bar_date date, close double, arima_return double, hybrid_return double, alpha double")
    got = {r.series_id: r for r in forecast_response(latest).collect()}
    assert (got["s"].model, got["s"].signal, got["s"].predicted_price, str(got["s"].forecast_for)) == ("hybrid", "BUY", 101.0, "2024-03-11")
    assert (got["r"].model, got["r"].signal) == ("arima", "HOLD")
    assert select_primary("a", "b", "x", "y") is not None and signal_label("a") is not None


def test_articles(spark):
    docs = ['{"publishedAt": "2024-01-02T10:00:00Z", "title": "b", "source": {"name": "n"}}', '{"publishedAt": "2024-01-01T09:00:00Z", "title": null, "source": null}']
    rows = news.parse_news_articles(spark.createDataFrame([(d,) for d in docs], "article string")).collect()
    assert [(r.title, r.source, r.url) for r in rows] == [("", "", ""), ("b", "n", "")]


# --- streams, one file per micro-batch
@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    n = 600
    t0 = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], n), "ts": t0 + pd.to_timedelta(np.arange(n) * 20, "min"), "value": rng.normal(50, 5, n)})
    root = tmp_path_factory.mktemp("ticks")
    for i, part in enumerate(np.array_split(np.arange(n), 4)):
        spark.createDataFrame(pdf.iloc[part].sample(frac=1, random_state=i)).coalesce(1).write.mode("append").parquet(str(root / "data"))
    return pdf, str(root / "data")


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_ema_equals_batch(spark, ticks, tmp_path):
    pdf, path = ticks
    out = st.run_available(st.stream_ema(stream(spark, path), "k", "ts", "value", 12), str(tmp_path / "o"), str(tmp_path / "c")).toPandas()
    assert len(out) == len(pdf)
    for k, g in pdf.groupby("k"):
        got = out[out.k == k].sort_values("ts").ema.to_numpy()
        np.testing.assert_allclose(got, g.value.ewm(span=12, adjust=False).mean(), rtol=1e-12)


def test_stream_regime_equals_batch(spark, ticks, tmp_path):
    from tests.test_chunks import plain_forward

    pdf, path = ticks
    p = Params([0.5, 0.5], [0.9, 0.1, 0.2, 0.8], [48.0, 52.0], [16.0, 40.0])
    out = st.run_available(st.stream_hmm_filter(stream(spark, path), "k", "ts", ["value"], p), str(tmp_path / "o"), str(tmp_path / "c")).toPandas()
    for k, g in pdf.groupby("k"):
        got = np.stack(out[out.k == k].sort_values("ts").filtered)
        np.testing.assert_allclose(got, plain_forward(g.value.to_numpy(), p), atol=1e-10)


def test_a_large_micro_batch_is_held_as_numbers_and_handed_on_in_slices(spark, ticks, monkeypatch):
    """The regime filter's step on one key: memory a row, rows a frame, and the posteriors of shuffled rows with ties."""
    import tracemalloc
    from types import SimpleNamespace

    from pyspark.sql import GroupedData

    from tests.test_chunks import plain_forward

    steps = []
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, step, *rest: steps.append(step))
    p = Params([0.5, 0.5], [0.9, 0.1, 0.2, 0.8], [48.0, 52.0], [16.0, 40.0])
    st.stream_hmm_filter(stream(spark, ticks[1]), "k", "ts", ["value"], p)
    n = 200_000
    rng = np.random.default_rng(8)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 2, "s")
    x, order = rng.normal(50, 5, n), rng.permutation(n)
    ties = np.lexsort((np.argsort(order), np.arange(n) // 2))  # of equal times the first to arrive comes first
    frames = (pd.DataFrame({"k": "a", "ts": t[part], "value": x[part]}) for part in np.array_split(order, 40))
    state = SimpleNamespace(exists=False, update=lambda v: setattr(state, "kept", v))
    tracemalloc.start()
    sizes, got = [], np.empty(n)
    at = 0
    for f in steps[0](("a",), frames, state):
        sizes.append(len(f))
        got[at : at + len(f)] = [v[1] for v in f.filtered]
        at += len(f)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n and max(sizes) <= 1 << 14 and peak < 120 * n
    want = plain_forward(x[ties], p)[:, 1]
    np.testing.assert_allclose(got, want, atol=1e-10)
    assert state.kept[0] == t[-1].to_pydatetime() and state.kept[1][1] == pytest.approx(want[-1])


def test_stream_bars_final_once_and_late_rows_dropped(spark, ticks, tmp_path):
    pdf, path = ticks
    bars = st.stream_bars(stream(spark, path), "k", "ts", "value", "30 minutes")
    out = st.run_available(bars, str(tmp_path / "o"), str(tmp_path / "c"))
    days = {str(r.bar_date) for r in out.collect()}
    last = pdf.ts.max().normalize()
    assert str(last.date()) not in days and str((last - pd.Timedelta(days=1)).date()) in days
    before = out.toPandas().sort_values(["series_id", "bar_date"], ignore_index=True)
    late = spark.createDataFrame(pd.DataFrame({"k": ["a"], "ts": [pd.Timestamp("2024-01-01 05:00:00")], "value": [9999.0]}))
    late.coalesce(1).write.mode("append").parquet(path)
    after = st.run_available(bars, str(tmp_path / "o"), str(tmp_path / "c")).toPandas().sort_values(["series_id", "bar_date"], ignore_index=True)
    first = after[(after.series_id == "a") & (after.bar_date.astype(str) == "2024-01-01")]
    assert len(first) == 1 and first.high.iloc[0] < 9999 and len(after) == len(before)


def test_ties_over_two_batches_are_all_taken(spark, tmp_path):
    at = pd.Timestamp("2024-01-01")
    for v in (1.0, 2.0, 4.0):
        spark.createDataFrame(pd.DataFrame({"k": ["a"], "ts": [at], "value": [v]})).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    out = st.run_available(st.stream_ema(stream(spark, str(tmp_path / "d")), "k", "ts", "value", 3), str(tmp_path / "o"), str(tmp_path / "c")).toPandas()
    assert sorted(out.value) == [1.0, 2.0, 4.0]


def test_sinks_give_one_row_per_key_over_several_batches(spark, ticks, tmp_path):
    from barloom.operators import drift

    pdf, path = ticks
    rows = spark.read.parquet(path).filter("value < 9000")
    reference = rows.select("k", "value")
    edges = drift.psi_edges(reference, ["k"])
    counts = drift.bucket_counts(reference.withColumn("is_reference", F.lit(True)), edges, ["k"])
    st.run_batches(stream(spark, path).filter("value < 9000").select("k", "value"), st.psi_batch(edges, ["k"], str(tmp_path / "p")), str(tmp_path / "pc"))
    got = st.read_psi(spark, str(tmp_path / "p"), counts, ["k"]).collect()
    assert sorted(r.k for r in got) == ["a", "b"] and all(abs(r.psi) < 1e-9 and r.n_current == (pdf.k == r.k).sum() for r in got)
    params = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.5)], "k string, intercept double, slope double")
    st.run_batches(stream(spark, path).filter("value < 9000"), st.forecast_batch(params, str(tmp_path / "f"), "k", "ts", "value"), str(tmp_path / "fc"))
    newest = {r.k: r for r in st.read_newest(spark, str(tmp_path / "f"), ["k"], "ts").collect()}
    for k, g in pdf.groupby("k"):
        last = g.sort_values("ts").iloc[-1]
        assert newest[k].value == last.value and newest[k].predicted == pytest.approx({"a": 1.0, "b": 2.0}[k] + 0.5 * last.value)
