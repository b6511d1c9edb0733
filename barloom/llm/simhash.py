"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints have 64 bits. Bits that go together are grouped into partitions of equal width; a dynamic program gives
each partition its own threshold, -1 (skipped) or more, so that the thresholds add up to radius - partitions + 1 and the
estimated work is least. Two fingerprints within the radius then agree within the threshold in at least one partition:
each fingerprint stands in the table under its own value of every partition and probes all values within the
threshold. Candidates that meet there are verified on all bits.

Inside a table slot only links that join something are kept: a walk over the slot takes a fingerprint, links it to every
fingerprint not yet reached within the radius, and goes on from those. The components are the same as with all links, and
a slot of n fingerprints gives fewer than n of them. Slots above BLOCK fingerprints, and the slots these probe, are cut
into blocks, and every two blocks are compared in a task of their own.

Exact copies share a fingerprint and are one node. Null or empty texts have fingerprint zero, linked like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.words import released
from barloom.session import written

BITS = 64
BLOCK = 4096
SEED = 42


def _fingerprint(words: list[bytes], width: int, distinct: bool) -> int:
    if not words:
        return 0
    spans = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if width > 1 else words
    if distinct:
        spans = list(dict.fromkeys(spans))
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in spans], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, width: int = 3, distinct: bool = False) -> DataFrame:
    """Every row with `_fp`, a signed 64-bit fingerprint, in place of its text."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*keep).alias("row") if keep else F.struct(F.lit(0)).alias("row"), F.col(text).alias("_t"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, _fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_fingerprint((t.as_py() or "").encode().lower().split(), width, distinct) for t in b.column("_t")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["row", "_fp"])

    return rows.mapInArrow(released(run), schema).select("row.*", "_fp")


def _bit_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS), dtype=np.int64)
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
        x = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
        both += (x.T @ x).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both.ravel())], ["i", "j", "n"])


def correlated_groups(fps: DataFrame, parts: int) -> list[list[int]]:
    """Partitions of bits: each begins with the free bit most tied to others and takes those most correlated with it."""
    table = fps.select("_fp").mapInArrow(released(_bit_table), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((BITS, BITS))
    both[table["i"], table["j"]] = table["n"]
    total = max(1.0, float(fps.count()))
    p = np.diag(both) / total
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / total - np.outer(p, p)) / np.outer(sd, sd))
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        first = max(free, key=lambda i: (tie[i, free].sum(), -i))
        group = [first]
        while len(group) < size:
            group.append(max((i for i in free if i not in group), key=lambda i: (tie[i, group].sum(), -i)))
        groups.append(sorted(group))
        free = [i for i in free if i not in group]
    return groups


def _project(fp: Column, bits: Sequence[int]) -> Column:
    """The named bits as a number: runs of neighbouring bits are shifted together."""
    out, at, k = None, 0, 0
    while k < len(bits):
        n = 1
        while k + n < len(bits) and bits[k + n] == bits[k] + n:
            n += 1
        piece = F.shiftleft(F.shiftrightunsigned(fp, bits[k]).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1).cast("long")), at)
        out = piece if out is None else out.bitwiseOR(piece)
        at, k = at + n, k + n
    return out


def _probes(width: int, threshold: int) -> list[int]:
    """Masks of up to `threshold` flipped bits."""
    masks, layer = [0], [0]
    for _ in range(threshold):
        layer = sorted({m | 1 << i for m in layer for i in range(width) if m < 1 << i})
        masks += layer
    return masks


def thresholds(costs: list[list[float]], total: int) -> list[int]:
    """One threshold a partition, adding up to `total`, of least cost; costs[i][t + 1] is that of threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        best_next: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, cost in enumerate(row, -1):
                if s + t not in best_next or c + cost < best_next[s + t][0]:
                    best_next[s + t] = (c + cost, [*chosen, t])
        best = best_next
    return best[total][1]


PROBE_COST, PAIR_COST = 1.0, 0.01  # a row to shuffle and sort, against one comparison of two numbers


def allocate(fps: DataFrame, radius: int, parts_choices: Sequence[int] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest plan. Slot sizes are counted over all fingerprints for threshold 0; each
    allowed flip is taken to multiply candidates and probes by the number of values it reaches."""
    n, plans = fps.count(), []
    for m in parts_choices:
        groups = correlated_groups(fps, m)
        pairs = [0.0] * m
        slots = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("p"), _project(F.col("_fp"), g).alias("v")) for i, g in enumerate(groups)])).alias("s"))
        met = slots.groupBy("s").agg(F.count("*").alias("k")).groupBy("s.p").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("c"))
        for row in met.collect():  # one row a partition
            pairs[row["p"]] = row["c"]
        most = radius - m + 1 + (m - 1)  # where all others are skipped
        costs = [[0.0] + [PROBE_COST * n * (1 + len(_probes(len(g), t))) + PAIR_COST * pairs[i] * len(_probes(len(g), t)) for t in range(min(most, 3) + 1)] for i, g in enumerate(groups)]
        try:
            chosen = thresholds(costs, radius - m + 1)
        except KeyError:
            continue
        plans.append((sum(costs[i][t + 1] for i, t in enumerate(chosen)), [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def _walk(own: np.ndarray, probe: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a slot: `own` stand in it, `probe` reach it. Every link has an end in `own`; enough for its components."""
    a, b = [], []
    if len(own) > 2:  # begin where most are near
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").mean(0) > 0.5
        own = own[np.argsort(np.bitwise_count(own ^ np.packbits(bits, bitorder="little").view("<u8")[0]), kind="stable")]
    left_own, left_probe = own, np.setdiff1d(probe, own, assume_unique=True)
    while len(left_own):
        todo_own, todo_probe = [left_own[:1]], []
        left_own = left_own[1:]
        while todo_own or todo_probe:
            if todo_own:
                x = todo_own[-1][0]
                todo_own[-1] = todo_own[-1][1:]
                if not len(todo_own[-1]):
                    todo_own.pop()
                near = np.bitwise_count(left_probe ^ x) <= radius
                if near.any():
                    got, left_probe = left_probe[near], left_probe[~near]
                    a.append(np.full(len(got), x)), b.append(got), todo_probe.append(got)
            else:
                x = todo_probe[-1][0]
                todo_probe[-1] = todo_probe[-1][1:]
                if not len(todo_probe[-1]):
                    todo_probe.pop()
            near = np.bitwise_count(left_own ^ x) <= radius
            if near.any():
                got, left_own = left_own[near], left_own[~near]
                a.append(np.full(len(got), x)), b.append(got), todo_own.append(got)
    return a, b


def _links(radius: int):
    """Links of slots; a partition's rows come sorted by slot. Slots that meet nothing cost no loop."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            slot, tag, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cols = [slot, tag >> 1, fp, tag & 1]
            if held:
                cols = [np.concatenate(x) for x in zip(held[0], cols)]
            if not len(cols[0]):
                continue
            new = np.ones(len(cols[0]), dtype=bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield cols[2][:last], cols[3][:last], new[:last]
            held = [[c[last:] for c in cols]]
        if held:
            new = np.zeros(len(held[0][0]), dtype=bool)
            new[:1] = True
            yield held[0][2], held[0][3], new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, own, new in slots(batches):
            fp = fp.view(np.uint64)
            starts = np.append(np.flatnonzero(new), len(fp))
            size, n_own = np.diff(starts), np.add.reduceat(own.astype(np.int64), starts[:-1])
            a, b = [], []
            two = starts[:-1][(size == 2) & (n_own >= 1)]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a.append(fp[near]), b.append(fp[near + 1])
            for k in np.flatnonzero((size > 2) & (n_own >= 1)):
                f, o = fp[starts[k] : starts[k + 1]], own[starts[k] : starts[k + 1]].astype(bool)
                x, y = _walk(np.unique(f[o]), np.unique(f[~o]), radius)
                a += x
                b += y
            a, b = np.concatenate(a), np.concatenate(b)
            keep = a != b
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int, plan: list[tuple[list[int], int]], block: int = BLOCK) -> DataFrame:
    """(a, b): links within the radius between distinct fingerprints, enough to give all components."""
    fp = F.col("_fp")
    place = lambda i, v: F.lit(i << 56).cast("bigint").bitwiseOR(v)  # noqa: E731  partition and value in one number
    near = [F.array(*[F.lit(m).cast("bigint") for m in _probes(len(bits), t)]) for bits, t in plan]
    # slots that stand out by what stands in them, and the slots that these probe, are cut into blocks; all others hold at
    # most `block` rows of their own and as many from each slot that probes them
    own = fps.select(F.explode(F.array(*[F.struct(place(i, _project(fp, bits)).alias("slot"), F.lit(i).alias("i")) for i, (bits, _) in enumerate(plan)])).alias("s"))
    crowded = own.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    masks = F.get(F.array(*near), F.col("s.i"))
    spread = crowded.select("n", F.explode(F.transform(masks, lambda m: F.col("s.slot").bitwiseXOR(m))).alias("_slot"))
    large = written(spread.groupBy("_slot").agg(F.ceil(F.sum("n") / block).cast("int").alias("k")))
    rows = None
    for i, (bits, _) in enumerate(plan):
        probe = F.transform(near[i], lambda m: F.struct(place(i, _project(fp, bits).bitwiseXOR(m)).alias("slot"), (m == 0).cast("int").alias("own")))  # noqa: B023
        rows = probe if rows is None else F.concat(rows, probe)
    rows = fps.select("_fp", F.explode(rows).alias("s")).select("s.slot", "s.own", "_fp")
    joined = rows.join(F.broadcast(large) if large.count() * 32 <= 8 << 20 else large, rows["slot"] == large["_slot"], "left")
    at = F.pmod(F.xxhash64("_fp"), F.col("k")).cast("int")
    pair = lambda i: F.least(at, i) * F.col("k") + F.greatest(at, i)
    pairs = F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1), pair))
    dealt = joined.select("slot", F.explode(pairs).alias("g"), "_fp", "own").select("slot", (2 * F.col("g") + F.col("own")).alias("tag"), "_fp")
    met = dealt.repartition("slot", F.shiftright("tag", 1)).sortWithinPartitions("slot", "tag")
    return met.mapInArrow(released(_links(radius)), "a long, b long")


def near_duplicates(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(_fp, root) of every fingerprint that is linked to another; `fps` has distinct fingerprints in a written table."""
    return components(written(links(fps, radius, allocate(fps, radius))))


def with_component(rows: DataFrame, doc_id: str, radius: int = 3) -> DataFrame:
    """Rows with `_fp` and `component_id`, the smallest id reachable over links (null ids only: null)."""
    rows = written(rows)
    fps = written(rows.groupBy("_fp").agg(F.min(doc_id).alias("least")))
    roots = written(near_duplicates(fps, radius))
    named = fps.join(roots, "_fp", "left").select("_fp", "least", F.coalesce("root", "_fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = written(named.join(least, "root").select("_fp", "component_id"))
    return rows.join(table, "_fp")
