import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import decontaminate
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        k = min(window, len(x))
        mine = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if x else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in mine:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), tuple(sorted(found))


def marks(docs, bench, **kw):
    rows = decontaminate.mark(docs, bench, **kw).select("doc.doc_id", "n_words", "spans", "items").collect()
    return sorted(((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), tuple(r["items"])) for r in rows), key=repr)


def bench_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark, make, odd):
    text = " ".join(f"w{i}" for i in range(40))
    items = [(1, text), (2, "Short item"), (3, None), (4, "..."), (5, " ".join(f"w{i}" for i in range(25, 60))), (6, "same words " * 12), (7, "z")]
    rows = odd + [
        (30, "before " + text.upper() + " after", "a"), (31, " ".join(f"w{i}" for i in range(9)), "a"), (32, "a short, ITEM here short item", "a"),
        (33, "same words " * 30, "a"), (34, " ".join(f"w{i}" for i in range(20, 36)) + " gap " + text, "a"), (35, "w1 w2 " + "z-z", "a"), (36, "short", "a"), (37, "item", "a"),
    ]
    want = sorted(((i, *brute(t, items)) for i, t, _ in rows), key=repr)
    assert marks(make(rows), bench_of(spark, items)) == want
    assert marks(make(rows), bench_of(spark, items), block_words=15) == want  # several passes, and with block_words=6 several jobs
    assert marks(make(rows), bench_of(spark, items), block_words=6) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=6), st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=4), st.integers(2, 5))
def test_suffix_arrays_on_small_alphabets(docs, items, window):
    from barloom.llm.words import _NOT_ALNUM, Words

    texts = [" ".join(f"a{x}" for x in d) for d in docs]
    bench = [(i, " ".join(f"a{x}" for x in d)) for i, d in enumerate(items)]
    block = [(str(i), 0, len(h), h) for i, t in bench for h in [decontaminate._item_words(t)] if len(h)]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.cumsum([0, *(len(t) for t in texts)])
    w = Words(raw, bounds, _NOT_ALNUM)
    mask, found = decontaminate._hits(w, decontaminate._Queries(block, window))
    for i, t in enumerate(texts):
        own = mask[w.offsets[i] : w.offsets[i + 1]]
        assert (len(own), int(own.sum()), tuple(sorted(found[i]))) == brute(t, bench, window)


def test_longest_match_and_removal(spark, make):
    text = [f"w{i}" for i in range(50)]
    docs = make([(1, "x y " + " ".join(text[5:30]) + " q", "a"), (2, "clean text", "a"), (3, None, None)])
    bench = bench_of(spark, [(9, " ".join(text))])
    best = max(decontaminate.longest_matches(docs, bench).collect(), key=lambda r: r.length)
    assert (best.item_id, best.item_word, best.length, best.doc_id, best.doc_word) == ("9", 5, 25, 1, 2)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_empty_tables(spark, make):
    docs = make([(1, "some text", "a")])
    assert marks(docs, bench_of(spark, [])) == [(1, 2, 0, ())]
    assert marks(docs.limit(0), bench_of(spark, [(1, "some text")])) == []


def test_query(spark):
    import hashlib

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {d.doc_id: brute(d.text, items) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op9_decontamination"](spark, SF).collect():
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
