import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import mixing, rules
from barloom.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


def measures(text):
    w = re.findall(r"[^ \t-\r]+", text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [s for s in (text or "").split("\n") if re.search(r"[^ \t-\r]", s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_ledger_against_brute_force(make, odd):
    rows = odd + [
        (20, "a b c d e f g h " * 3, "x"), (21, "p q r s t u v w x " + "a b c d e f g h i " * 2, "x"), (22, "same line\nsame line\n\n \nother", "x"),
        (23, "###|||$ %%% <b> & *", "x"), (24, "z " * 5000, "x"), (25, "a b c d e f g h", "x"), (26, "a b c d e f g a b c d e f g a b c d e f g", "x"),
    ]
    got = rules.ledger(make(rows)).select("doc.doc_id", "doc.text", "doc.failed", *rules.MEASURES[:5]).collect()
    assert sorted(map(repr, [(r.doc_id, r.text, *r[3:]) for r in got])) == sorted(map(repr, [(i, t, *measures(t)) for i, t, _ in rows]))
    assert {r.failed for r in got} == {9}  # the documents' own column


def test_policy_and_ablation(make, spark):
    good = " ".join(f"word{i}" for i in range(40))
    docs = make([(1, good, "a"), (2, "short", "a"), (3, good.replace("word", "#"), "a"), (4, None, None), (5, "# " * 5, "a")])
    kept = rules.apply_policy(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    found = {r.rule: (r.failing, r.failing_alone) for r in rules.ablation(rules.ledger(docs)).collect()}
    assert found["few_words"] == (3, 2) and found["symbols"] == (2, 1) and found["duplicate_lines"] == (0, 0)
    assert rules.apply_policy(docs.limit(0)).count() == 0
    assert {r.failing for r in rules.ablation(rules.ledger(docs.limit(0))).collect()} <= {0}


def test_quality_query_matches_sql(spark):
    assert compare(QUERIES["op7_quality_rules"](spark, SF), ORACLES["op7_quality_rules"], duck(SF)) is None


def fill(sizes, weights, share, most):
    """Targets by the plain loop: cap what is above, share the excess again."""
    budget, target, open_ = share * sum(sizes.values()), {}, dict(weights)
    while open_:
        level = (budget - sum(target.values())) / sum(open_.values())
        above = [s for s in open_ if open_[s] * level > most * sizes[s] + 1e-9]
        if not above:
            return target | {s: w * level for s, w in open_.items()}
        for s in above:
            target[s] = most * sizes[s]
            del open_[s]
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, make, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{rng.integers(0, 7)}" if i % 3 else "hot") for i in range(900)] + [(1000, None, None), (1001, "a b c", None), (1002, "", "void")]
    docs = make(rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    again = sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    got = mixed.collect()
    assert sorted(map(repr, got)) == again
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    sizes, taken, times = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    for r in got:
        taken[r.source] += size(r.text)
        times[r.doc_id] += 1
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    assert max(times.values()) <= 2
    largest = defaultdict(int)
    for _, t, s in rows:
        largest[s] = max(largest[s], size(t))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], (s, taken[s], want[s])


def test_mix_of_odd_and_empty_tables(make, odd):
    docs = make(odd)
    assert set(mixing.mix(docs).columns) == set(docs.columns)
    assert mixing.mix(docs).count() > 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_query(spark):
    rows = QUERIES["op1_mixing"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
