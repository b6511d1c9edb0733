import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import dedup, simhash
from barloom.llm.components import components
from barloom.llm.queries import QUERIES
from barloom.llm.words import released
from barloom.session import written

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, radius):
    part = list(range(len(fps)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                part[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def groups(ids, labels):
    out = {}
    for i, k in zip(ids, labels):
        out.setdefault(k, []).append(i)
    return sorted(sorted(v) for v in out.values())


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: fingerprint(d.text) for d in docs}
    got = QUERIES["op2_simhash"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in want.items()}
    ids = sorted(want)
    root = roots([want[i] for i in ids], 3)
    least = {k: min(i for i, r in zip(ids, root) if r == k) for k in set(root)}
    assert {r.doc_id: r.component_id for r in got} == {i: least[k] for i, k in zip(ids, root)}


def test_all_links_of_planted_distances(spark):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for base in fps[:20]:
        for k in (1, 2, 3, 4):
            fps.append(base ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    hub = fps[0]
    fps += [hub ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))]
    fps = sorted(set(fps))
    table = written(spark.createDataFrame([(signed(f),) for f in fps], "_fp long"))
    for radius, block in ((3, 4096), (3, 16), (5, 32)):
        for plan in (simhash.allocate(table, radius), [(list(range(16 * i, 16 * i + 16)), t) for i, t in enumerate({3: (0, 0, 0, 0), 5: (1, 1, 0, 0)}[radius])]):
            found = components(simhash.links(table, radius, plan, block))
            root = {r._fp: r.root for r in found.collect()}
            assert groups(fps, [root.get(signed(f), signed(f)) for f in fps]) == groups(fps, roots(fps, radius))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.floats(0, 100), min_size=4, max_size=4), min_size=2, max_size=4), st.integers(-1, 3))
def test_thresholds_are_least(costs, total):
    from itertools import product

    sums = [sum(c[t + 1] for c, t in zip(costs, ts)) for ts in product(range(-1, 3), repeat=len(costs)) if sum(ts) == total]
    if not sums:
        return
    chosen = simhash.thresholds(costs, total)
    assert sum(chosen) == total and abs(sum(c[t + 1] for c, t in zip(costs, chosen)) - min(sums)) < 1e-9


def test_components_of_a_long_chain_and_a_star(spark):
    chain, star = [(i, i + 1) for i in range(100, 160)], [(1000, i) for i in range(1001, 1300)]
    got = {r._fp: r.root for r in components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert set(got.values()) == {100, 1000} and len(got) == 61 + 300


def test_odd_rows(make, odd):
    docs = make(odd)
    rows = simhash.with_component(simhash.fingerprints(docs.select("doc_id", "text"), "text"), "doc_id").collect()
    assert len(rows) == len(odd)
    assert {r.component_id for r in rows if r._fp == 0} == {2}
    empty = docs.limit(0)
    assert simhash.with_component(simhash.fingerprints(empty.select("doc_id", "text"), "text"), "doc_id").count() == 0
    kept = dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 4, 7]
    assert dedup.drop_near_duplicates(empty).count() == 0


def test_near_copies_go_and_clean_documents_stay(make):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, keep = [], []
    for g in range(40):
        base = [word() for _ in range(200)]
        rows.append((10 * g, " ".join(base), "a"))
        keep.append(10 * g)
        for k in range(1, 4):
            copy = list(base)
            copy[int(rng.integers(0, 200))] = word()
            rows.append((10 * g + k, " ".join(copy) if k < 3 else " ".join(base), "b"))
    got = sorted(r.doc_id for r in dedup.drop_near_duplicates(make(rows)).collect())
    assert got == keep


def alike_groups(texts):
    """The least member of each text's group, by the Jaccard similarity of all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(texts)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    linked = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                x, y = sorted((find(i), find(j)))
                part[y] = x
    return sorted({find(i) for i in range(len(sets))}), linked


def test_no_pair_of_dense_fingerprints_is_missed(spark, make):
    """Reordered texts share all their words, and filled-in templates most: near copies among them are found whoever leads."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):  # one set of words, so one fingerprint
        base = [str(x) for x in rng.permutation(vocabulary)]
        copy = list(base)
        at = int(rng.integers(0, 100))
        copy[at], copy[at + 1] = copy[at + 1], copy[at]
        texts += [" ".join(base), " ".join(copy)]
    form = [f"form{i}" for i in range(80)]
    for _ in range(40):
        fill = [f"v{int(x)}" for x in rng.integers(0, 10**6, 60)]
        texts += [" ".join(form + fill), " ".join(form + fill + ["end"])]
    want, linked = alike_groups(texts)
    assert linked == 100
    docs = make([(i, t, "a") for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in dedup.drop_near_duplicates(docs).collect()) == want
    marked = dedup._marked(docs, "text", "doc_id")
    best = [r.best.id for r in dedup.near_duplicates(marked, "text", block=16).groupBy("root").agg({"best": "min"}).toDF("root", "best").collect()]
    assert sorted(best) == want


def edited_pairs():
    """(text, copy) of Jaccard similarity 0.8 to 0.9: words appended, cut off at the end or replaced, at several lengths."""
    rng = np.random.default_rng(12)
    words = lambda n: [f"u{int(x)}" for x in rng.integers(0, 10**9, n)]
    out = []
    for size in (30, 60, 200, 600):
        for k in range(10):
            few = (size - 4) * (11 + k) // 100  # in shingles, of which appended or cut words change one each and replaced ones about five
            first, second, base = words(size), words(size), words(size)
            out += [(first, first + words(few)), (second, second[: size - few])]
            copy = list(base)
            for at in rng.choice(size // 5, max(1, few // 10), replace=False):
                copy[5 * int(at) + 2] = words(1)[0]
            out.append((base, copy))
    sets = [[{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in p] for p in out]
    return [(" ".join(a), " ".join(b)) for (a, b), (x, y) in zip(out, sets) if 0.8 <= len(x & y) / len(x | y) <= 0.9]


def test_recall_of_edited_copies_is_whole(make):
    pairs = edited_pairs()
    assert len(pairs) >= 80
    docs = make([(2 * i + k, t, "a") for i, p in enumerate(pairs) for k, t in enumerate(p)])
    assert sorted(r.doc_id for r in dedup.drop_near_duplicates(docs).collect()) == [2 * i for i in range(len(pairs))]


def test_near_duplicates_begin_with_groups_of_fingerprints(spark, make, monkeypatch):
    """Groups are those of all fingerprint pairs within three bits, and the removal takes its first links from them."""
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(30):
        base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            copy = list(base)
            copy[int(rng.integers(0, 300))] = "x"
            texts.append(" ".join(copy))
    texts += ["", "a", "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, _t string")
    got = {r.b: r.a for r in dedup.fingerprint_groups(rows, "_t").collect()}
    root = roots([fingerprint(t) for t in texts], 3)
    assert groups(range(len(texts)), [got.get(i, i) for i in range(len(texts))]) == groups(range(len(texts)), root)
    assert len(got) > 20 and all(a < b for b, a in got.items())
    asked = []
    own = dedup.fingerprint_groups
    monkeypatch.setattr(dedup, "fingerprint_groups", lambda *args: asked.append(args) or own(*args))
    kept = dedup.drop_near_duplicates(make([(i, t, "a") for i, t in enumerate(texts)]))
    assert sorted(r.doc_id for r in kept.collect()) == alike_groups(texts)[0] and len(asked) == 1


def test_only_pairs_that_share_several_first_shingles_are_candidates(spark, make):
    """Long texts with a few phrases in common pass sizes and bitmaps, yet only near copies go on to have their sets compared;
    the first round takes at most one pair a text."""
    rng = np.random.default_rng(31)
    texts = []
    for i in range(40):
        words = [f"w{i}x{k}" for k in range(1500)]
        for p in rng.choice(50, 10, replace=False):
            at = int(rng.integers(0, len(words)))
            words[at:at] = [f"p{p}x{k}" for k in range(5)]
        texts += [" ".join(words), " ".join(words + [f"e{i}x{k}" for k in range(170)])]
    docs = make([(i, t, "a") for i, t in enumerate(texts)])
    rows = dedup._marked(docs, "text", "doc_id").select("node", F.col("doc.text").alias("_t"))
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    met, bitmaps = written(dedup._meetings(rows, none, 0.8)), written(dedup._bitmaps(rows))
    apart = spark.createDataFrame([], "node long, root long")
    assert dedup._apart(dedup._several(met, apart, 4096), bitmaps, 0.8, None).count() == 40
    assert 40 <= dedup._leading(met).count() <= len(texts)
    assert sorted(r.doc_id for r in dedup.drop_near_duplicates(docs).collect()) == list(range(0, 80, 2))


def test_short_texts_against_all_pairs(make):
    rng = np.random.default_rng(32)
    texts = []
    for size in range(1, 15):
        for k in range(6):
            base = [f"s{int(x)}" for x in rng.integers(0, 10**6, size)]
            texts += [" ".join(base), " ".join(base).upper(), " ".join(base + ["end"]), " ".join(base[1:])]
    want, linked = alike_groups(texts)
    assert linked > 100
    assert sorted(r.doc_id for r in dedup.drop_near_duplicates(make([(i, t, "a") for i, t in enumerate(texts)])).collect()) == want


def test_texts_stay_where_they_lie(spark, make, monkeypatch):
    """No join shuffles the texts however many rows are kept, and where their bits are too many to broadcast the rows are the same."""
    docs = make([(i, f"one two three four five t{i % 150} u{i % 150} v{i % 150}", "a") for i in range(400)]).repartition(3)
    marked = dedup._marked(docs, "text", "doc_id")
    assert marked.agg(F.max("row")).first()[0] > 1 << 33
    some = [r.row for r in marked.select("row").collect()][::7]
    monkeypatch.setattr(dedup, "_marked", lambda *_: marked)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, shuffled in ((dedup.BROADCAST, False), (0, True)):
            monkeypatch.setattr(dedup, "BROADCAST", most)
            got = dedup._only(marked, dedup._row_bits(spark.createDataFrame([(x,) for x in some], "row long")))
            assert got.columns == marked.columns and sorted(r.row for r in got.select("row").collect()) == sorted(some)
            kept = dedup.drop_near_duplicates(docs)
            assert ("Exchange hashpartitioning" in kept._jdf.queryExecution().executedPlan().toString()) == shuffled
            assert sorted(r.doc_id for r in kept.collect()) == list(range(150))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_task_gives_its_memory_back(monkeypatch):
    """What a task's function held is free when the pools are told to release it, also what the last batch was cut from."""
    held = []

    class Pool:
        def release_unused(self):
            held.append(pa.total_allocated_bytes())

    def run(batches):
        for b in batches:
            yield pa.record_batch({"x": pa.array(np.zeros(1 << 20)).take(pa.array(np.arange(1 << 20)))}).slice(0, b.num_rows)

    before = pa.total_allocated_bytes()
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    monkeypatch.setattr(pa, "system_memory_pool", Pool)
    rows = 0
    for out in released(run)(pa.record_batch({"x": [1.0, 2.0]}) for _ in range(3)):
        rows += out.num_rows
    assert rows == 6 and len(held) == 2 and max(held) < before + (1 << 20)
    assert list(released(run)(iter([]))) == []
