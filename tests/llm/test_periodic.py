import hashlib
import random
import zlib

import numpy as np
import pytest

from barloom.llm import periodic
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(w, least=24, times=3):
    """Every period and every stretch of agreement, one word at a time; of the same stretch the smallest period."""
    out = {}
    for p in range(len(w) // times, 0, -1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                out[(i, j - i + p)] = p
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def left_over(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(v for i, v in enumerate(w) if i not in gone)


def words_with_runs(rng):
    n, kinds = rng.choice([0, 1, 5, 23, 24, 30, 100, 400, 900]), rng.choice([1, 2, 3, 50])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 30 else 0):
        a = rng.randrange(n - 10)
        p = rng.randint(1, max(1, (n - a) // 3))
        for i in range(a + p, rng.randint(a + p, n)):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("r", [0, 1, 2])
def test_difference_covers(r):
    v, cover = periodic.difference_cover(r)
    assert {int((a - b) % v) for a in cover for b in cover} == set(range(v)) and len(cover) == 6 * r + 4


def test_extensions_are_common_prefixes():
    rng = np.random.default_rng(3)
    for n, kinds in ((2, 1), (40, 1), (300, 2), (700, 2000), (900, 3)):
        code = np.append(rng.integers(1, kinds + 1, n), kinds + 5)
        code[n // 2 : n] = code[: n - n // 2]  # a long common stretch
        i, j = rng.integers(0, len(code), (2, 400))
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(len(code)) if max(a, b) + k >= len(code) or code[a + k] != code[b + k]) for a, b in zip(i, j)]
        assert list(periodic.Extensions(code)(i, j)) == want


def test_runs_are_all_runs():
    rng = random.Random(1)
    for _ in range(60):
        texts = [words_with_runs(rng) for _ in range(rng.randint(1, 7))]
        offsets = np.cumsum([0] + [len(t) for t in texts])
        names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        got = [[] for _ in texts]
        if offsets[-1]:
            for t, s, n, p in zip(*periodic.runs_of(np.array([names[w] for t in texts for w in t]), offsets)):
                got[t].append((int(s), int(n), int(p)))
        assert got == [brute(t) for t in texts]


def test_points_in_many_blocks_give_the_same(monkeypatch):
    code = np.tile(np.arange(40), 30)
    code[500:600] = 7
    want = [list(x) for x in periodic.runs_of(code, np.array([0, 700, 1200]))]
    monkeypatch.setattr(periodic, "_ROWS", 37), monkeypatch.setattr(periodic, "_POINTS", 11)
    assert [list(x) for x in periodic.runs_of(code, np.array([0, 700, 1200]))] == want and want[0]


def test_rows_of_all_kinds(make, odd):
    rng = random.Random(2)
    rows = odd + [(20 + i, "  \t" + "\n ".join(words_with_runs(rng)) + " \r", "a") for i in range(30)] + [(60, "Ha ha " * 30, None), (61, "é ü\x1cx é ü\x1cx " * 9, "a")]
    docs = make(rows)
    got = periodic.mark(docs).collect()
    assert len(got) == len(rows)
    texts = {(i, s): t for i, t, s in rows}
    for r in got:
        w = (texts[(r.doc.doc_id, r.doc.source)] or "").encode().split()
        if r.doc.doc_id not in (4, 5):
            w = [x.decode() for x in w]
            runs = brute(w)
            assert r.n_words == len(w) and [tuple(x) for x in r.runs] == runs and r.collapsed == left_over(w, runs)
        else:
            assert r.n_words == len(w) and not brute(w[:3000]) and len(r.collapsed) <= len(texts[(r.doc.doc_id, r.doc.source)])
    cut = periodic.collapse(docs)
    assert cut.columns == docs.columns and cut.filter("doc_id = 60").first().text == "Ha ha" and cut.filter("doc_id = 2").first().text == ""
    assert periodic.mark(docs.limit(0)).count() == 0 and periodic.collapse(docs.select("text")).count() == len(rows)


def test_a_long_text_in_slices_of_its_own(make, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_BYTES", 500)
    block = [f"v{i}" for i in range(3000)]
    text = " ".join(block * 4 + ["end"])
    got = {r.doc.doc_id: r for r in periodic.mark(make([(1, text, "a"), (2, "x y", "a"), (3, "z " * 40, "a")])).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 12000, 3000)] and got[1].collapsed == " ".join([*block, "end"])
    assert not got[2].runs and [tuple(x) for x in got[3].runs] == [(0, 40, 1)] and got[3].collapsed == "z"


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = [x.decode() for x in (d.text or "").encode().split()]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w[a:] = [w[a + i % p] for i in range(n - a)]
            planted += 1
        elif n > 3000:
            continue  # the brute force takes the square of the words
        runs, r = brute(w), got[d.doc_id]
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in sorted(runs, key=lambda x: (x[0], x[2])))
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(left_over(w, runs).encode()).hexdigest()
        if runs:
            s, m, p = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, m, p, 1000 * m // p)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert planted > 5
