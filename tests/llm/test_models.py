import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import hmm_lm, language, quality_model, urls
from barloom.llm.queries import QUERIES
from barloom.llm.words import Lookup, Words, text_slices

SF = "/root/testdata/sf0.001"


def test_words_and_hashes():
    texts = ["The cat\tthe  CAT", None, "", " x", "naïve naïve", "the"]
    seen = {}
    for at, to, raw, bounds in text_slices(pa.array(texts), 8):
        w = Words(raw, bounds)
        for i in range(to - at):
            own = slice(w.offsets[i], w.offsets[i + 1])
            got = [raw[a:b].tobytes().lower() for a, b in zip(w.start[own], w.end[own])]
            assert got == (texts[at + i] or "").encode().lower().split()
            for word, h in zip(got, w.hash[own]):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_lookup():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    other = rng.integers(0, 2**63, 1000).astype(np.uint64)
    table = Lookup(keys)
    assert (table(keys) == np.arange(5000)).all() and (table(other) == -1).all() and (Lookup(keys[:0])(other) == -1).all()


def test_exact_likelihood_of_long_texts():
    rng = np.random.default_rng(1)
    k, c = 3, 7
    m = hmm_lm.Model(1, 1, c, None, None, None, np.ones(1), None, rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    sizes = [1, 2, 63, 64, 65, 128, 129, 700]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    cls = rng.integers(0, c, starts[-1])
    for got, a, b in zip(hmm_lm._likelihood(m, cls, starts), starts, starts[1:]):
        alpha, log = m.start * m.emit[cls[a]], 0.0
        for t in range(a + 1, b):
            log += math.log(alpha.sum())
            alpha = alpha / alpha.sum() @ m.move * m.emit[cls[t]]
        assert got == pytest.approx(log + math.log(alpha.sum()), rel=1e-9)


def test_expected_counts_against_sums_over_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    k, c = 2, 3
    m = hmm_lm.Model(1, 1, c, None, None, None, np.ones(1), None, rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    cls, starts = np.array([0, 2, 1, 1, 0]), np.array([0, 3, 5])
    counts, moves, first = np.zeros((c, k)), np.zeros((k, k)), np.zeros(k)
    hmm_lm._expected(m, cls, starts, m.emit.astype(np.float32), counts, moves, first)
    want_c, want_m = np.zeros((c, k)), np.zeros((k, k))
    for a, b in ((0, 3), (3, 5)):
        paths = list(product(range(k), repeat=b - a))
        p = [m.start[z[0]] * m.emit[cls[a], z[0]] * math.prod(m.move[z[i - 1], z[i]] * m.emit[cls[a + i], z[i]] for i in range(1, b - a)) for z in paths]
        for z, w in zip(paths, np.array(p) / sum(p)):
            for i in range(b - a):
                want_c[cls[a + i], z[i]] += w
                if i:
                    want_m[z[i - 1], z[i]] += w
    assert np.allclose(counts, want_c, atol=1e-5) and np.allclose(moves, want_m, atol=1e-5)


@pytest.mark.parametrize("span", [2, 3, 7, 64])
def test_expected_counts_do_not_depend_on_stretches(monkeypatch, span):
    """Counts and likelihood of whole texts, by a plain forward and backward pass a text."""
    monkeypatch.setattr(hmm_lm, "SPAN", span)
    rng = np.random.default_rng(12)
    k, classes = 3, 5
    unit = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape) + 0.05)
    m = hmm_lm.Model(0, 0, classes, None, None, None, None, None, unit(k), unit(k, k), unit(k, classes).T)
    starts = np.cumsum([0, 1, 2, 30, 7, 64, 65, 200])
    cls = rng.integers(0, classes, starts[-1])
    counts, moves, first = np.zeros((classes, k)), np.zeros((k, k)), np.zeros(k)
    log = hmm_lm._expected(m, cls, starts, m.emit.astype(np.float32), counts, moves, first)
    want_c, want_m, want_f, want_log = np.zeros((classes, k)), np.zeros((k, k)), np.zeros(k), 0.0
    for a, b in zip(starts, starts[1:]):
        e = m.emit[cls[a:b]]
        fwd, beta = np.zeros_like(e), np.ones_like(e)
        for t in range(len(e)):
            v = (fwd[t - 1] @ m.move if t else m.start) * e[t]
            want_log += np.log(v.sum())
            fwd[t] = v / v.sum()
        for t in range(len(e) - 2, -1, -1):
            v = m.move @ (e[t + 1] * beta[t + 1])
            beta[t] = v / v.sum()
        gamma = fwd * beta / (fwd * beta).sum(1, keepdims=True)
        want_f += gamma[0]
        np.add.at(want_c, cls[a:b], gamma)
        for t in range(1, len(e)):
            x = fwd[t - 1][:, None] * m.move * (e[t] * beta[t])
            want_m += x / x.sum()
    np.testing.assert_allclose(counts, want_c, rtol=2e-4), np.testing.assert_allclose(moves, want_m, rtol=2e-4), np.testing.assert_allclose(first, want_f, rtol=2e-4)
    assert abs(log - want_log) < 1e-4 * abs(want_log)
    assert abs(want_log - hmm_lm._likelihood(m, cls, starts).sum()) < 1e-8 * abs(want_log)


def test_likelihood_rises_by_rounds(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    m = hmm_lm.train(texts, "text", hmm_lm.word_counts(texts, "text"), rounds=5)
    assert len(m.likelihoods) == 5 and all(a < b for a, b in zip(m.likelihoods, m.likelihoods[1:]))


def test_language_model_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_hmm_lm"](spark, SF).collect()}
    docs = [(d.doc_id, (d.text or "").encode().lower().split() + [None]) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in docs if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in docs:
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_of_odd_rows(make, odd):
    from pyspark.sql import functions as F

    docs = make(odd)
    out, m = hmm_lm.score_all(docs, F.lit(True))
    rows = out.select("doc.doc_id", "n_tokens", "n_known", "score").collect()
    assert len(rows) == len(odd) and all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in rows)
    assert sum(r.n_tokens for r in rows) == m.tokens
    assert hmm_lm.score_all(docs.limit(0), F.lit(True))[0].count() == 0
    unseen, _ = hmm_lm.score_all(docs, F.lit(False))
    assert all(math.isfinite(r.score) for r in unseen.collect())


def test_pair_sum_in_linear_time():
    rng = np.random.default_rng(3)
    m = quality_model.Machine(0.2, rng.normal(0, 1, quality_model.WIDTH), rng.normal(0, 0.3, (quality_model.WIDTH, 4)))
    _, _, raw, bounds = next(text_slices(pa.array(["some words and some more", ""])))
    doc, i, x = quality_model.features(raw, bounds)
    for d, got in enumerate(m.score(raw, bounds)):
        f, v = i[doc == d], x[doc == d]
        z = 0.2 + m.weights[f] @ v + sum(m.factors[f[a]] @ m.factors[f[b]] * v[a] * v[b] for a in range(len(f)) for b in range(a))
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op4_quality_model"](spark, sf).collect()
    out = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([a == b for a, b in out]) > 0.9


def test_quality_of_odd_rows_and_one_class(make, odd, spark):
    from pyspark.sql import functions as F

    docs = make(odd)
    for labels in ([(1, 1), (2, 0), (7, None)], [(1, 1)], []):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        machine = quality_model.fit(*quality_model.sample(docs, table, F.lit(True)))
        rows = quality_model.score(docs, machine).collect()
        assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.score(docs.limit(0), machine).count() == 0


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = [r for r in QUERIES["op6_language_id"](spark, sf).collect() if r.held_out]
    assert np.mean([want[r.doc_id] == r.lang_pred for r in out]) > 0.95


def test_spans_scripts_and_odd_texts(spark, odd, make):
    from pyspark.sql import functions as F

    en, de = "the house and the water are there with them", "das haus und die nacht sind nicht für mich"
    ru = "это было очень давно и никто не знал"
    train = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 20)], "doc_id long, text string, lang string")
    m = language.fit(train, F.lit(True))
    mixed = make([(1, f"{en} {en} {de} {de} {ru}", "a"), (2, None, "a"), (3, "123 --- 45", "a"), (4, "", "a"), (5, "東京", "a"), (6, "ру", "a")])
    got = {r.doc.doc_id: r.spans for r in language.spans(mixed, m).collect()}
    n = len(en.split())
    assert [s.lang for s in got[1]] == ["en", "de", "ru"]
    assert abs(got[1][0].end - 2 * n) <= 1 and got[1][1].end == 2 * n + 2 * len(de.split()) and got[2] == []
    pred = {r.doc.doc_id: (r.lang_pred, r.score) for r in language.predict(mixed, m).collect()}
    assert pred[2] == pred[3] == pred[4] == ("und", 0.0) and pred[6][0] == "ru" and pred[5][0] in ("en", "de", "ru") and pred[5][1] == 0
    docs = make(odd)
    assert language.predict(docs, m).count() == len(odd) and language.predict(docs.limit(0), m).count() == 0
    none = language.fit(train.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_short_cut_gives_the_path_of_the_full_walk():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = rng.integers(1, 40, 6)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        text = np.repeat(np.arange(6), sizes)
        s = rng.normal(0, 3, (offsets[-1], 3)) + np.array([1.0, 0, 0])
        total = np.add.reduceat(s, offsets[:-1])
        walk = language._needs_walk(s, text, offsets, total)
        for i, p in enumerate(language._walk(s, offsets[:-1], sizes, language.SWITCH)):
            if not walk[i]:
                assert (p == total[i].argmax()).all()


def verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_urls(spark):
    given = [
        None, "", "no scheme", "http://Example.ORG/es/x?q=1#f", "http://a.example.org/en/12", "http://example.org/en/2", "http://example.orgx/es/", "https://x.com/fr/1", "https://x.com/de", "https://com/de/",
        "a://b://c/d", "http://HOST?x=/y", "http://casino-win.example.net/en/5", "https://quiet.example.net/en/77", "http://org", "x://ÜBER.org/ä", "http://a.com/de/\nnext",
    ]
    model = urls.fit(urls.labelled(spark))
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(given)], "page_id long, url string, host string")
    rows = {r.doc.page_id: r for r in urls.judge(pages, model).collect()}
    for i, u in enumerate(given):
        host, path, rule, by_rule = verdict(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == by_rule if by_rule else rows[i].verdict in ("allow", "block")
    assert rows[12].verdict == "block" and rows[13].verdict == rows[0].verdict == "allow" and rows[0].doc.host == "own"
    assert urls.keep_allowed(pages, model).columns == pages.columns and urls.judge(pages.limit(0), model).count() == 0


def test_every_label_is_learned(spark):
    """More than 128 labels, one text each beside a large one, of which the sample takes few."""
    from pyspark.sql import functions as F

    word = lambda k, i: "".join("bcdfghklmn"[(k // 10**j) % 10] + "aeiou"[(k + i + j) % 5] for j in range(3)) + f"{'xyz'[i % 3]}"
    few = [(k, " ".join(word(k, i) for i in range(30)), f"lang{k:03d}") for k in range(150)]
    docs = spark.createDataFrame(few + [(1000 + i, "the river runs past old stone mills again", "big") for i in range(2000)], "doc_id long, text string, lang string")
    m = language.fit(docs, F.lit(True), sample=100)
    assert sorted(m.names) == sorted({"big"} | {x[2] for x in few})
    got = {r.doc.doc_id: r.lang_pred for r in language.predict(docs, m).collect()}
    assert all(got[k] == name for k, _, name in few) and got[1000] == "big"


def test_training_reads_classes_that_are_written_once(spark, monkeypatch):
    """Rounds work on a table of classes: the texts are encoded once, and the counts are those of the texts."""
    rng = np.random.default_rng(41)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, n) % 50) for n in (0, 1, 5, 64, 65, 400, 3000)] + [None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    m = hmm_lm._empty_model(hmm_lm.word_counts(docs, "text"))
    tables = list(hmm_lm._classes(type("B", (), {"value": m}))(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])])))
    w = Words(*next(text_slices(pa.array(texts)))[2:])
    want, starts = hmm_lm._with_end(w, m.encode(w)[0], 0)
    for limit in (1 << 18, 100, 1):
        monkeypatch.setattr(hmm_lm, "TOKENS", limit)
        got = list(hmm_lm._class_slices(iter(tables), m.kind))
        assert (np.concatenate([c for c, _ in got]) == want).all()
        assert (np.concatenate([np.diff(s) for _, s in got]) == np.diff(starts)).all()
        assert len(got) == {1 << 18: 1, 1: len(texts)}.get(limit, len(got))
    written = []
    own = hmm_lm.written
    monkeypatch.setattr(hmm_lm, "written", lambda df: written.append(df.columns) or own(df))
    hmm_lm.train(docs, "text", hmm_lm.word_counts(docs, "text"), rounds=2)
    assert written == [["classes"]]
