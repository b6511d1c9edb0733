import re

import pytest

from barloom.llm import licenses
from barloom.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, duck

SPLIT = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [w for w in SPLIT.split(lower) if w]


def shares(w, phrase):
    """Words of the template that stand on each diagonal in pairs, and within the slack around it."""
    p, votes = phrase.split(), {}
    for i in range(len(w) - 1):
        for t in range(len(p) - 1):
            if w[i : i + 2] == p[t : t + 2]:
                votes.setdefault(i - t, set()).update((t, t + 1))
    pairs = {}
    for i in range(len(w) - 1):
        for t in range(len(p) - 1):
            if w[i : i + 2] == p[t : t + 2]:
                pairs.setdefault(i - t, set()).add(t)
    near = {d: set().union(*(votes[e] for e in votes if abs(e - d) <= licenses.SLACK)) for d in votes}
    return {d: (len(near[d]) / len(p) if len(p) >= licenses.NOTICE else len(votes[d]) / len(p), len(votes[d]) / len(p), len(pairs[d]) == len(p) - 1) for d in votes}


def brute(t):
    w = words(t)
    base, labels, score = [], set(), 0.0
    for k, (label, phrase) in enumerate((*licenses.BASE, *licenses.TEMPLATES)):
        got = shares(w, phrase)
        score = max([score, *(m for m, _, _ in got.values())])
        whole = [d for d, x in got.items() if x[2]]
        if k < len(licenses.BASE):
            base += [(d, label) for d in whole]
        if whole or (len(phrase.split()) >= licenses.NOTICE and any(m >= licenses.NEARLY for m, _, _ in got.values())):
            labels.add(label)
    at = sorted(d for d, _ in base)
    return len(w), len(base), at[0] if at else None, at[-1] if at else None, sorted({x for _, x in base}), sorted(labels), score


@pytest.fixture(scope="module")
def texts():
    mit, gpl = licenses.TEMPLATES[8][1].split(), licenses.TEMPLATES[11][1].split()
    return [
        "CC-BY cc by; (CC) by. All Rights\n\nReserved all rights all rights reserved", "accc by", "general public licenses", "GENERAL PUBLIC LICENSE", "cc", "ÀLL rights reserved Üall rights reserved all  rights reserved",
        " ".join(mit), " ".join(mit[:10] + ["very", "new"] + mit[10:20] + mit[21:]), " ".join(mit[::2]), " ".join(mit[:12]), "x " * 50 + " ".join(gpl) + " y" * 20 + " " + " ".join(gpl),
        " ".join(mit[:14] + ["far"] * 9 + mit[14:]), "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Released under the MIT License; released under the apache license, version 2.0", "under the " * 300,
        "This work is licensed under the GNU General Public License, version 3.", "cc by " * 2000, "a\x00cc\x1fby\x7fb",
    ]


def test_against_brute_force(make, odd, texts):
    rows = odd + [(20 + i, t, "a") for i, t in enumerate(texts)]
    docs = make(rows)
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    by = {(i, s): t for i, t, s in rows}
    for r in got:
        want = brute(by[(r.doc.doc_id, r.doc.source)])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, pytest.approx(r.score)) == want
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs.select("text")).count() == len(rows)


def test_spans(make, texts):
    second = 50 + len(licenses.TEMPLATES[11][1].split()) + 20
    got = sorted((r.doc.doc_id, r.label, r.start) for r in licenses.spans(make([(i, t, "a") for i, t in enumerate(texts)])).collect())
    assert [x for x in got if x[0] == 0] == [(0, "cc-by", 0), (0, "cc-by", 2), (0, "cc-by", 4), (0, "reserved", 6), (0, "reserved", 11)]
    assert [x for x in got if x[0] == 10] == [(10, "gpl", 50), (10, "gpl", 69), (10, "gpl", second), (10, "gpl", second + 19)]  # the phrase inside each notice, too
    assert [x for x in got if x[0] == 7] == [(7, "mit", 0)]  # cut and widened, still one span; of equally full diagonals the first
    assert len([x for x in got if x[0] == 17]) == 2000


def test_own_templates(make):
    docs = make([(1, "alpha beta gamma delta", "a"), (2, "beta alpha", "a")])
    got = {r.doc.doc_id: r for r in licenses.scan(docs, templates=(("own", "beta gamma"),), base=()).collect()}
    assert got[1].labels == ["own"] and got[1].score == 1.0 and got[1].n_base == 0 and got[2].labels == [] and got[2].score == 0.0
    with pytest.raises(ValueError):
        licenses.scan(docs, templates=(("one", "word"),))


def test_query(spark):
    assert compare(QUERIES["op11_license_scan"](spark, "/root/testdata/sf0.001"), ORACLES["op11_license_scan"], duck("/root/testdata/sf0.001")) is None
    plan = QUERIES["op11_license_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
