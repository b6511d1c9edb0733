import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import negatives
from barloom.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, duck

SCHEMA = "vec_id long, embedding array<float>, label int, q string, score double, anchor long, cluster string"


def brute(rows, is_anchor, positives=5, negatives_=3, low=50, high=95):
    some = []
    for i, v, y in rows:
        if i is None or y is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        some.append((i, [math.floor(256 * float(x)) for x in v], y))
    out = []
    for i, a, y in some:
        if not is_anchor(i):
            continue
        near = sorted((-sum(p * q for p, q in zip(a, b)), j, z) for j, b, z in some if len(b) == len(a))
        for ps, pj, _ in [x for x in near if x[2] == y and x[1] != i][:positives]:
            fits = [x for x in near if x[2] != y and low * -ps <= 100 * -x[0] <= high * -ps][:negatives_]
            out += [(i, pj, k + 1, nj, -ps, -ns) for k, (ns, nj, _) in enumerate(fits)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y, "own", 0.5, 9, "c") for i, v, y in rows], SCHEMA)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_equals_brute_force(spark, spread, monkeypatch):
    rng = np.random.default_rng(5)
    heart = rng.normal(size=(6, 8))
    rows = [(int(i), [float(np.float32(x)) for x in heart[i % 6] + spread * rng.normal(size=8)], int(i % 4)) for i in range(700)]
    want = brute(rows, lambda i: i % 10 == 0)
    for shard, chunk, piece, block in ((4 << 20, 1 << 20, 4096, 256), (300, 200, 8, 3)):  # many shards, chunks and blocks
        for name, v in (("SHARD", shard), ("CHUNK", chunk), ("PIECE", piece), ("BLOCK", block), ("PER_CLUSTER", 9)):
            monkeypatch.setattr(negatives, name, v)
        assert result(negatives.mine(table(spark, rows), F.col("id") % 10 == 0)) == want
    assert len(want) > 300


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=3), 1)], int(i % 2)) for i in range(60)]
    rows += rows[:20] + [(i, [0.5, 0.5, 0.5], 1) for i in (100, 101, 100)]  # repeated rows and ties
    rows += [(200, None, 1), (201, [], 1), (202, [1.0, None, 1.0], 1), (203, [1.0, float("nan"), 1.0], 0), (204, [1.0, float("inf"), 1.0], 0), (205, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 0)]
    rows += [(210, [1.0, 2.0], 0), (215, [1.0, 1.5], 0), (211, [1.0, 1.0], 1), (220, [0.0, 0.0, 0.0], 1), (225, [7.0], 1)]  # other lengths, zero, alone
    assert result(negatives.mine(table(spark, rows), F.col("id") % 5 == 0)) == brute(rows, lambda i: i % 5 == 0)
    assert result(negatives.mine(table(spark, []), F.col("id") % 5 == 0)) == []
    assert result(negatives.mine(table(spark, rows), F.col("id") > 1000)) == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=4) * 10 ** rng.integers(0, 6)], int(i % 3)) for i in range(200)]
    rows += [(300 + i, [1e30, 1.0, 1.0, 1.0], 1) for i in range(3)]  # beyond what a long holds: out
    assert result(negatives.mine(table(spark, rows), F.col("id") % 10 == 0)) == brute(rows[:200], lambda i: i % 10 == 0)


def test_walks_end_early(monkeypatch):
    """In tight clusters a member reads little of its list, and what is left unread is certified."""
    rng = np.random.default_rng(8)
    heart = rng.normal(size=(40, 32))
    x = np.floor(256 * (np.repeat(heart, 100, 0) + 0.01 * rng.normal(size=(4000, 32)))).astype(np.int64)
    read = []
    keep = negatives.np.nonzero
    monkeypatch.setattr(negatives.np, "nonzero", lambda m: (read.append(m.size), keep(m))[1])
    ((m, _, i, v),) = negatives._walk(x[:50], np.arange(50), x, np.arange(4000), np.full((50, 1), -(2**62)), np.full((50, 1), 2**62), 5)
    score = x[:50] @ x.T
    score[np.arange(50), np.arange(50)] = -(2**62)
    assert [list(i[m == k]) for k in range(50)] == [list(np.lexsort((np.arange(4000), -score[k]))[:5]) for k in range(50)]
    assert sum(read) < 50 * 4000 / 4


def test_query(spark):
    assert compare(QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.01"), ORACLES["op12_hard_negatives"], duck("/root/testdata/sf0.01")) is None
