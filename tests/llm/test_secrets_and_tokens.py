import hashlib
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import decontaminate, rules, secrets, tokens
from barloom.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    t = t or ""
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(s + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_spans_and_ownership(make, odd):
    key = "AKIA" + "Q" * 16
    rows = odd + [(40 + i, f"é {key} and Secret: token: abcdefgh 'API_KEY' = \"own{i}own{i}own{i}\" end", f"s{i}") for i in range(5)]
    rows += [(60, "token=short password='longenough1' 0123456789abcdef01234567 \U0001f600 apikey:x=y=zzzzzz", "s1"), (61, "gh" + "p_" + "zQ1" * 12, "s1"), (62, "AKIA AKIAAKIA" + "Z9" * 8 + " " + "f" * 23, None)]
    docs = make(rows)
    got = secrets.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {(i, s): t for i, t, s in rows}[(r.doc.doc_id, r.doc.source)]
        if r.doc.doc_id in (1, 4, 5) or r.doc.doc_id is None:
            continue
        assert [(s.start, s.rank, s.end) for s in r.spans if s.rank < 3] == base_spans(text)
        for s in r.spans:
            if text[s.start : s.end] == key:
                assert s.owners == 5 and not s.live
            elif "own" in text[s.start : s.end]:
                assert s.owners == 1 and s.live
    assert [s.rank for r in got if r.doc.doc_id == 61 for s in r.spans] == [3] or [s.rank for r in got if r.doc.doc_id == 61 for s in r.spans] == [3, 4]
    assert secrets.scan(docs.limit(0)).count() == 0


def brute_more(t):
    """Further spans that overlap no base span."""
    base = base_spans(t)
    found = []
    for rank, kind in enumerate(secrets.KINDS):
        if kind in secrets.MORE:
            pattern, part, least = secrets.MORE[kind]
            found += [(m.start(), rank, m.end(), m[part]) for m in re.finditer(pattern, t) if len(m[part]) >= least]
    return sorted(x for x in found if all(x[2] <= a or x[0] >= e for a, _, e in base))


def test_further_kinds_owners_and_repositories(make):
    key = lambda i: "gh" + "p_" + f"aB3{i}" * 8
    rows = [(i, f"x {key(1)} y", "one") for i in range(40)]  # one owner, many repositories
    rows += [(100 + i, f"{key(2)} token={key(3)} zz", f"s{i % 2}") for i in range(4)]  # two owners, few repositories
    rows += [(200 + i, f"é {key(4)} q1w2e3r4t5y6u7i8o9p0a1s2d3", f"s{i}") for i in range(3)]  # three owners
    rows += [(300, f"{key(5)} {key(5)} secret: {key(6)}{key(7)} AKIA{'Z' * 16} {'0f' * 12}", None), (301, "abcdefgh" * 9, "s")]
    counts = {}
    for i, t, s in rows:
        for a, k, e, v in brute_more(t):
            counts.setdefault(v, set()).add((s, i))
    for r in secrets.scan(make(rows)).collect():
        text = next(t for i, t, _ in rows if i == r.doc.doc_id)
        want = []
        for a, k, e, v in brute_more(text):
            owners, repositories = len({s for s, _ in counts[v]}), len(counts[v])
            if owners <= 2 and repositories <= 16:
                want.append((a, k, e, owners, repositories, True))
        assert [tuple(s)[:3] + (s.owners, s.repositories, s.live) for s in r.spans if s.rank >= 3] == want
        assert [(s.start, s.rank, s.end) for s in r.spans if s.rank < 3] == base_spans(text)
    few = {r.doc.doc_id: r.spans for r in secrets.scan(make(rows)).collect()}
    assert not [s for s in few[0] if s.rank >= 3] and [s.owners for s in few[100] if s.rank >= 3] == [2, 2]


def test_many_spans_in_one_text(make):
    """Work is linear: tens of thousands of spans in one text."""
    text = "".join(f"token=abcdef{i:06d} ghp_{i:036d} " for i in range(32_000))
    docs = make([(1, text, "a"), (2, "token=abcdefgh", "a")])
    secrets.scan(make([(2, "token=abcdefgh", "a")])).collect()
    began = time.monotonic()
    got = {r.doc.doc_id: r.spans for r in secrets.scan(docs).collect()}
    took = time.monotonic() - began
    assert [(s.start, s.rank, s.end) for s in got[1] if s.rank < 3] == base_spans(text) and len(got[1]) >= 64_000 and took < 40


def test_secret_query(spark):
    want = {d.doc_id: base_spans(d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op5_secret_scan"](spark, SF).collect():
        s = want[r.doc_id]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in s)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in s) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40))
def test_blocks_round_trip(values):
    ranks = np.array(values, dtype=np.uint32)
    control, data = tokens.pack(ranks)
    assert len(control) == -(-len(values) // 4) and len(data) == sum(max(1, -(-v.bit_length() // 8)) for v in values)
    assert (tokens.unpack(control, data, len(values)) == ranks).all()


TOK = Tokenizer.from_file(vocabulary())
with open(vocabulary(), encoding="utf-8") as f:
    MODEL = f.read()


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u0301ée's'tAZß1½İ<|>"), st.characters(codec="utf-8")), max_size=40))
def test_words_encode_as_whole_texts(text):
    assert np.frombuffer(tokens.ids_of([text], MODEL, 1)[0], "<u4").tolist() == [*TOK.encode(text, add_special_tokens=False).ids, 1]


def test_a_full_cache_changes_nothing(monkeypatch):
    texts = ["alpha beta gamma", "delta alpha epsilon"]
    want = tokens.ids_of(texts, MODEL, 1)
    tokens._CACHED.clear()
    monkeypatch.setattr(tokens, "CACHE", 2)
    assert tokens.ids_of(texts, MODEL, 1) == want


def stream(docs):
    at, out = 0, {}
    for i, t in docs:
        ids = np.array([*TOK.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.setdefault(i, []).append((at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_query(spark):
    want = stream(sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()))
    got = {r.doc_id: [(r.start, r.n_tokens, r.ids_crc32)] for r in QUERIES["op10_token_ids"](spark, SF).collect()}
    assert got == want


def test_token_files_of_odd_rows(spark, make, odd):
    docs = make(odd)
    folder = tokens.encode(docs, vocabulary(), files=5)
    rows = tokens.decoded(spark, folder, lambda x: x.tolist(), "array<long>").orderBy("part", "pos").collect()
    assert sorted(map(repr, [(r.doc_id, r.value) for r in rows])) == sorted(repr((i, [*TOK.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _ in odd)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    got = sorted((r.start, r.n_tokens) for r in tokens.digests(spark, folder).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and got[0][0] == 0
    assert tokens.digests(spark, tokens.encode(docs.limit(0), vocabulary())).count() == 0


def test_token_files_are_all_that_stays_and_are_compressed(spark):
    """The ids in between go, and the blocks take fewer bytes than the ranks in them."""
    from pathlib import Path

    import pyarrow.parquet as pq

    from barloom.session import shared_folder

    shared_folder(spark)  # names the folder of later calls
    tables = Path(shared_folder(spark).removeprefix("file:")) / "barloom-tables"
    there = lambda: {p.name for p in tables.glob("*")}
    before = there()
    folder = tokens.encode(spark.read.parquet(f"{SF}/documents.parquet"), vocabulary(), files=2)
    assert there() == before
    data = [pq.ParquetFile(p).metadata for p in Path(folder.removeprefix("file:")).glob("blocks/*.parquet")]
    data = [m.row_group(g).column(c) for m in data for g in range(m.num_row_groups) for c in range(m.num_columns) if m.schema.column(c).name == "data"]
    assert {c.compression for c in data} == {"ZSTD"} and sum(c.total_compressed_size for c in data) < 0.9 * sum(c.total_uncompressed_size for c in data)


def test_pipeline_stages(spark):
    """Each stage on its own input: what goes, what stays, and the columns."""
    from barloom.session import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        seen[name] = (before, docs)
        if name != "token_ids":
            assert docs.columns == before.columns
    before, after = seen["quality_rules"]
    good = {r.doc_id for r in QUERIES["op7_quality_rules"](spark, SF).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == good & {r.doc_id for r in before.collect()}
    before, after = seen["simhash_near_dedup"]
    texts, kept = [r.text for r in before.collect()], [r.text for r in after.collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(texts)

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    stay = [shingles(t) for t in kept]
    for t in set(texts) - set(kept):  # what goes has a like in the input
        own = shingles(t)
        assert any(len(own & s) >= 0.8 * len(own | s) for u in texts if u != t for s in [shingles(u)])
    close = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(stay) for b in stay[:i])
    assert close <= 1
    before, after = seen["benchmark_decontamination"]
    dirty = {r.doc.doc_id for r in decontaminate.mark(before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("size(spans) > 0").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - dirty
    before, after = seen["source_mixing"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    before, after = seen["token_ids"]
    want = stream(sorted((d.doc_id, d.text) for d in before.collect()))
    got = {}
    for r in after.collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    assert {i: sorted(v) for i, v in got.items()} == want
    assert rules.DEFAULT.mask == 2 ** len(rules.RULES) - 1


def test_ids_of_long_and_repeated_pieces():
    """Pieces of one id, of many, and of more than the short loop takes, next to empty texts."""
    from tokenizers import Tokenizer

    path = vocabulary()
    model, tok = open(path, encoding="utf-8").read(), Tokenizer.from_file(path)
    texts = ["", "the " + "qzxjkvw" * 40 + " the", None, "日本語" * 30 + " a", "the the of", " "]
    got = tokens.ids_of(texts, model, 1)
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert max(map(len, want)) > 40 and [list(memoryview(g).cast("I")) for g in got] == want


def test_pieces_are_encoded_once(monkeypatch):
    """Known pieces never go to the tokenizer again, and a table that is nearly full takes what it has room for."""
    asked = []

    class Watched:
        def __init__(self, tok):
            self.tok = tok

        def encode(self, text, **more):
            asked.extend(text.split())
            return self.tok.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            asked.extend(w for t in texts for w in t.split())
            return self.tok.encode_batch_fast(texts, **more)

    tokens._CACHED.clear()
    monkeypatch.setattr(tokens, "CACHE", 4)
    tokens.ids_of([""], MODEL, 1)
    for e in tokens._CACHED.values():
        e.tok = Watched(e.tok)
    texts = ["alpha beta, alpha", "gamma delta epsilon beta"]
    want = [[*TOK.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.ids_of(texts, MODEL, 1)] == want
    tokens._CACHED.clear()
    assert sorted(set(asked)) == sorted([",", "alpha", "beta", "delta", "epsilon", "gamma"]) and len(asked) == 6 + 2 * 2


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    """Hashes that say nothing but the number of a piece's bytes: length and sum of bytes part the pieces, in a call and between calls."""
    tokens._CACHED.clear()
    monkeypatch.setattr(tokens.Words, "hash", property(lambda w: (w.end - w.start).astype(np.uint64)))
    for texts in (["one two, six"], ["red six", "", "two. one!"], ["three seven eight one"]):
        want = [[*TOK.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.ids_of(texts, MODEL, 1)] == want
    tokens._CACHED.clear()


def test_wide_ids():
    """An end id beyond 16 bits."""
    texts = ["alpha beta", None, "gamma"]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.ids_of(texts, MODEL, 70_000)]
    assert got == [[*TOK.encode(t or "", add_special_tokens=False).ids, 70_000] for t in texts]
