"""Near-duplicate removal by SimHash groups, after which every pair of texts with alike five-word shingles is found.

Documents of equal text are one node. Two nodes are linked where their sets of five-word shingles have a Jaccard similarity
of `least` or more; the document of least id of each component stays. Null and empty texts are one text; a text without
words is similar only to texts without words.

Fingerprints (three-word shingles, RADIUS bits, as in `simhash`) group the texts first, and each text of a group is verified
against the group's first. Fingerprints miss near copies that are extended or cut, so an exact join follows and finds the
pairs still apart: put in any one order of all shingles, two alike sets share one of their first
n - ceil(least * n) + 1. The order takes shingles that are common in a sample of documents last, so that templates and
dense vocabularies meet rarely; a poor sample costs time, not pairs. The least node of a shingle leads it, and each node is
first verified against the node that leads most of its first shingles: one pair a node, which joins groups of copies. After
that every two nodes that share first shingles and lie in different components are compared. With SHARED - 1 more shingles
among the first, two alike sets share SHARED of them (or as many as they must have in common), so pairs that share fewer
never have their sets fetched. One bounded round (the NEAREST of each node) goes before, so that the last one, without a
bound, has few pairs left. A pair is tested by size and a bitmap of shingles, whose differing bits bound the difference of the
sets from below, and only then by the sets. Shingles of more than BLOCK nodes are cut into blocks, and every two blocks are
compared in a task of their own.

Texts are not shuffled: which rows are wanted travels as one bit a row (`_only`) to where the texts lie, unless the bits take more
than BROADCAST bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.components import components
from barloom.llm.words import Words, released, text_slices
from barloom.session import discard, written

SHINGLE, LEAST = 5, 0.8
RADIUS = 3  # bits in which linked fingerprints may differ
BLOCK, NEAREST = 4096, 4
SHARED = 4  # first shingles that two alike sets share at least, where they have as many in common
PAIRS = 1 << 18  # pairs of a task that are counted at a time
SAMPLE, COMMON, MOST_COMMON = 8_000, 4, 200_000  # documents counted for the order; their count from which a shingle is common
BITS = 512
BROADCAST = 32 << 20  # bytes of row bits, at 32 for 64 rows, up to which they are broadcast
SLACK = 1e-9  # bounds are rounded towards more candidates


def _sets(batches: Iterator[pa.RecordBatch], width: int = SHINGLE) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """First column and shingle sets (sorted distinct hashes) of slices of rows; the second column is the text."""
    for b in batches:
        for at, to, raw, bounds in text_slices(b.column(1), 1 << 19):
            w = Words(raw, bounds)
            sets = []
            for i in range(w.n_texts):
                h = w.hash[w.offsets[i] : w.offsets[i + 1]]
                sets.append(np.unique(_shingles(h, width, max(1, len(h) - width + 1))) if len(h) else h)
            yield b.column(0).slice(at, to - at), sets


def shingle_sets(rows: DataFrame, text: str, width: int = SHINGLE) -> DataFrame:
    """Rows with `_set`: sorted distinct 64-bit hashes of the shingles (shorter texts: of the whole sequence)."""
    keep = [c for c in rows.columns if c != text]
    wide = rows.select(F.struct(*keep).alias("row"), F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([row, pa.array([s.tobytes() for s in sets], pa.binary())], ["row", "_set"])

    return wide.mapInArrow(released(run), f"row {wide.schema['row'].dataType.simpleString()}, _set binary").select("row.*", "_set")


def _shingles(h: np.ndarray, width: int, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x"), b.column("y")
            ok = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p.as_py(), dtype=np.uint64), np.frombuffer(q.as_py(), dtype=np.uint64)
                both = np.intersect1d(p, q, assume_unique=True).size
                ok.append(both >= least * (len(p) + len(q) - both) - SLACK)  # two empty sets are alike
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _marked(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """A written table of every row: doc, id, node (hash of the text) and a row number."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col(doc_id).alias("id"), F.xxhash64(body, F.length(body)).alias("node"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "zstd")


def _row_bits(rows: DataFrame) -> DataFrame:
    """A written table of row numbers, 64 neighbours in one: (_word, _bits)."""
    bits = F.expr("bit_or(shiftleft(1L, cast(row & 63 as int)))")
    return written(rows.groupBy(F.shiftright("row", 6).alias("_word")).agg(bits.alias("_bits")))


def _only(marked: DataFrame, bits: DataFrame) -> DataFrame:
    """The `_marked` rows whose numbers are in a table of `_row_bits`."""
    few = F.broadcast(bits) if bits.count() * 32 <= BROADCAST else bits
    return marked.join(few, F.shiftright("row", 6) == F.col("_word")).filter("bit_get(_bits, cast(row & 63 as int)) = 1").select(*marked.columns)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _sets(batches):
        got = np.concatenate(sets).view(np.int64)
        for at in range(0, len(got), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(got[at : at + (1 << 16)])], ["token"])


def _common(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles common in a sample of the texts, sorted, and their counts: at most MOST_COMMON on the driver."""
    if n > SAMPLE:
        texts = texts.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
    counts = texts.select("node", "_t").mapInArrow(released(_tokens), "token bigint").groupBy("token").agg(F.count("*").alias("n"))
    top = counts.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(MOST_COMMON).toPandas()
    key, count = top["token"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64)
    order = np.argsort(key)
    return key[order], count[order]


def _first(s: np.ndarray, key: np.ndarray, count: np.ndarray, least: float) -> np.ndarray:
    """The shingles of a sorted set of which an alike set must share SHARED, or all they have in common if these are fewer;
    a set without shingles has the shingle 0."""
    if not len(s):
        return np.zeros(1, dtype=np.uint64)
    n = min(len(s), len(s) - int(np.ceil(least * len(s) - SLACK)) + SHARED)
    if not len(key):
        return s[:n]
    at = np.minimum(np.searchsorted(key, s), len(key) - 1)
    return s[np.argsort(np.where(key[at] == s, count[at], 0), kind="stable")[:n]]


def _meetings(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], least: float) -> DataFrame:
    """(token, lead, node) of each of the first shingles that more than one node has; lead is the least of them."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = shared.value
        for nodes, sets in _sets(batches):
            got = [_first(s, key, count, least) for s in sets]
            token, node = np.concatenate(got).view(np.int64), np.repeat(nodes.to_numpy(), [len(x) for x in got])
            for at in range(0, len(token), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(token[at : at + (1 << 16)]), pa.array(node[at : at + (1 << 16)])], ["token", "node"])

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by (token, node): the first of a token leads it, and is given when a second one comes
        last, lead, alone = None, 0, False
        for b in batches:
            token, node = b.column("token").to_numpy(), b.column("node").to_numpy()
            if not len(token):
                continue
            new = np.ones(len(token), dtype=bool)
            new[1:] = token[1:] != token[:-1]
            new[0] = token[0] != last
            starts = np.flatnonzero(new)
            at = np.searchsorted(starts, np.arange(len(token)), side="right") - 1
            leading = np.where(at >= 0, node[starts[np.maximum(at, 0)]] if len(starts) else 0, lead)
            more = ~new
            first = np.zeros(len(token), dtype=bool)
            first[:-1] = new[:-1] & more[1:]
            keep = more | first
            t, a, x = token[keep], leading[keep], node[keep]
            if alone and not new[0]:
                t, a, x = np.append(t, token[0]), np.append(a, lead), np.append(x, lead)
            alone = bool(new[-1])
            last, lead = token[-1], leading[-1]
            if len(t):
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(a), pa.array(x)], ["token", "lead", "node"])

    rows = texts.select("node", "_t").mapInArrow(released(prefixes), "token bigint, node bigint")
    return rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(released(leads), "token bigint, lead bigint, node bigint")


def _bitmaps(texts: DataFrame) -> DataFrame:
    """(node, n, wide, bits): the size of each set, the parity of its shingles in about as many classes, and folded to BITS classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, own in _sets(batches):
            wide, bits = [], []
            for s in own:
                classes = max(BITS, 1 << (len(s) - 1).bit_length()) if len(s) else BITS
                odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % classes, minlength=classes).astype(np.uint8) & 1
                wide.append(np.packbits(odd).tobytes())
                bits.append(np.packbits(np.bitwise_xor.reduce(odd.reshape(-1, BITS), axis=0)).tobytes())
            yield pa.RecordBatch.from_arrays([nodes, pa.array([len(s) for s in own], pa.int64()), pa.array(wide, pa.binary()), pa.array(bits, pa.binary())], ["node", "n", "wide", "bits"])

    return texts.select("node", "_t").mapInArrow(released(run), "node bigint, n bigint, wide binary, bits binary")


def _may_be_similar(least: float):
    """Pairs whose sizes and bitmaps do not rule them out."""
    share = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for n, m, p, q in zip(*(b.column(c).to_pylist() for c in ("n", "m", "x", "y"))):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                size = min(len(p), len(q))
                p, q = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (p, q))
                ok.append(min(n, m) >= least * max(n, m) - SLACK and int(np.bitwise_count(p ^ q).sum(dtype=np.int64)) <= share * (n + m) + SLACK)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _compare(least: float, nearest: int | None):
    """Pairs of a token's nodes in different components that may be alike (those of two blocks where there are two), with the
    tokens where a task met them and how many they must share."""
    share = (1 - least) / (1 + least)

    def pairs(node, root, n, side, bits):
        two = side.any() and not side.all()
        if side.any() and not two:
            return
        x_at, y_at = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(node)), np.arange(len(node)))
        y_bits, y_root, y_n = bits[y_at], root[y_at], n[y_at]
        for k, i in enumerate(x_at):
            after = 0 if two or nearest else k + 1
            may = np.flatnonzero((y_root[after:] != root[i]) & (np.minimum(y_n[after:], n[i]) >= least * np.maximum(y_n[after:], n[i]) - SLACK)) + after
            if not len(may):
                continue
            far = np.bitwise_count(y_bits[may] ^ bits[i]).sum(1, dtype=np.int64)
            near = far <= share * (y_n[may] + n[i]) + SLACK
            may, far = may[near], far[near]
            if nearest and len(may) > nearest:
                may = may[np.argsort(far, kind="stable")[:nearest]]
            if len(may):
                common = np.ceil(least / (1 + least) * (y_n[may] + n[i]) - SLACK)
                yield np.full(len(may), node[i]), node[y_at[may]], np.clip(common, 1, SHARED).astype(np.int64)

    def counted(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, y, need = (np.concatenate(c) for c in zip(*found))
        a, b = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        times = np.diff(np.append(first, len(a)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a[first], b[first], need[first], times)], ["a", "b", "need", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        size, held = 0, None

        def meet(cols, upto):
            token, group, node, root, n, side, bits = (c[:upto] for c in cols)
            cut = np.flatnonzero((token[1:] != token[:-1]) | (group[1:] != group[:-1])) + 1
            for a, e in zip(np.append(0, cut), np.append(cut, upto)):
                if e - a > 1:
                    yield from pairs(node[a:e], root[a:e], n[a:e], side[a:e], bits[a:e])

        def tables():
            nonlocal held
            for b in batches:
                if not b.num_rows:
                    continue
                cols = [b.column(c).to_numpy() for c in ("token", "g", "node", "root", "n", "side")]
                cols.append(np.frombuffer(b"".join(b.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64))
                if held:
                    cols = [np.concatenate(c) for c in zip(held, cols)]
                new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
                done = int(new[-1]) + 1 if len(new) else 0
                if done:
                    yield cols, done
                held = [c[done:] for c in cols]
            if held:
                yield held, len(held[0])

        for cols, upto in tables():
            for got in meet(cols, upto):
                found.append(got)
                size += len(got[0])
                if size >= PAIRS:
                    yield counted(found)
                    found, size = [], 0
        if found:
            yield counted(found)

    return run


def _several(met: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """A written table of the (token, node, root) of first shingles whose nodes lie in different components, with the number k
    of blocks that a shingle's nodes are cut into."""
    rows = written(met.select("token", "node").join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root")))
    several = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).filter("x <> y")
    out = written(rows.join(several.select("token", F.ceil(F.col("m") / block).cast("int").alias("k")), "token"))
    discard(rows)
    return out


def _apart(several: DataFrame, bitmaps: DataFrame, least: float, nearest: int | None) -> DataFrame:
    """(a, b): nodes that share enough first shingles, lie in different components and may be alike."""
    wide = several.join(bitmaps.select("node", "n", "bits"), "node")
    at = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    place = lambda i: F.struct((F.least(at, i) * F.col("k") + F.greatest(at, i)).cast("bigint").alias("g"), (at > i).cast("bigint").alias("side"))
    dealt = wide.select("token", "node", "root", "n", "bits", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), place)).alias("p"))
    dealt = dealt.select("token", F.col("p.g").alias("g"), "node", "root", "n", F.col("p.side").alias("side"), "bits")
    met = dealt.repartition("token", "g").sortWithinPartitions("token", "g").mapInArrow(released(_compare(least, nearest)), "a bigint, b bigint, need bigint, times bigint")
    return met.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("times").alias("times")).filter("times >= need").select("a", "b")


def _leading(met: DataFrame) -> DataFrame:
    """(a, b): each node that does not lead all its shingles, and the other node that leads most of them."""
    most = met.filter("lead <> node").groupBy("lead", "node").agg(F.count("*").alias("n")).groupBy("node").agg(F.max(F.struct("n", "lead")).alias("most"))
    return most.select(F.col("most.lead").alias("a"), F.col("node").alias("b"))


def fingerprint_groups(texts: DataFrame, text: str, radius: int = RADIUS) -> DataFrame:
    """(a, b): the least node and every other node of each group of texts that fingerprints link."""
    fps = written(simhash.fingerprints(texts.select("node", text), text))
    distinct = written(fps.select("_fp").distinct())
    roots = written(simhash.near_duplicates(distinct, radius))
    grouped = fps.join(roots, "_fp", "left").select("node", F.coalesce("root", "_fp").alias("group"))
    first = grouped.groupBy("group").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    out = written(grouped.join(first.select("group", "a"), "group").filter("node <> a").select("a", F.col("node").alias("b")))
    discard(fps), discard(distinct), discard(roots)
    return out


def near_duplicates(marked: DataFrame, text: str, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(node, root, best) of the distinct texts of `_marked` rows: best is the row that would stand for the text."""
    nodes = written(marked.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("best")))
    row_of = nodes.select("node", F.col("best.row").alias("row"))
    body = lambda bits: _only(marked, bits).select("node", F.col(f"doc.{text}").alias("_t"))
    distinct = _row_bits(row_of)
    texts = body(distinct)
    met = written(_meetings(texts, _common(texts, nodes.count()), least))
    bitmaps = written(_bitmaps(texts))

    def verified(pairs: DataFrame) -> DataFrame:
        end = lambda e, n, x: bitmaps.select(F.col("node").alias(e), F.col("n").alias(n), F.col("wide").alias(x))
        near = written(pairs.join(end("a", "n", "x"), "a").join(end("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(released(_may_be_similar(least)), "a bigint, b bigint"))
        wanted = _row_bits(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(row_of, "node"))
        sets = written(shingle_sets(body(wanted), "_t"))
        side = lambda end, name: sets.select(F.col("node").alias(end), F.col("_set").alias(name))
        both = near.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
        out = written(both.mapInArrow(released(_similar(least)), "a bigint, b bigint"))
        discard(near), discard(wanted), discard(sets)
        return out

    def joined(links: DataFrame) -> DataFrame:
        return written(components(links).withColumnRenamed("_fp", "node"))

    grouped = fingerprint_groups(texts, "_t")
    firsts = written(grouped.union(_leading(met)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = verified(firsts)
    roots = joined(links)
    discard(grouped), discard(firsts), discard(links)
    for nearest in (NEAREST, None):
        # a shingle whose nodes all lie in one component has no more to say
        several = _several(met, roots, block)
        discard(met)
        met = several
        pairs = written(_apart(several, bitmaps, least, nearest))
        if pairs.isEmpty():
            discard(pairs)
            break  # no two nodes in different components are left that may be alike
        links, old = verified(pairs), roots
        roots = joined(links.union(old.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(pairs), discard(links), discard(old)
    discard(met), discard(bitmaps), discard(distinct)
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "best")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One document of each group, with its own columns: that of least id, nulls last, the first of equal ids."""
    marked = _marked(docs, text, doc_id)
    best = near_duplicates(marked, text, least).groupBy("root").agg(F.min("best").alias("best"))
    return _only(marked, _row_bits(best.select(F.col("best.row").alias("row")))).select("doc.*")
