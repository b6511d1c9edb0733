"""Hard negatives from shared lists of anchor clusters.

Vectors become integers (floor of `scale` times each component), and a score is an integer inner product. Anchors of one
label are clustered; all members of a cluster share one list of candidates, sorted once by the greatest score that any
member could give: |x| cos(max(0, angle(x, centre) - widest angle of a member)), times the member's own length. Every
member walks the list from its top, and stops once the bound of what follows is below all that it still wants. So what
is left unread is certified, and results are exact.

A cluster's positives stand in the list of candidates with its own label, its negatives in the list of all others: every
candidate is sorted once a cluster. The first walk takes each anchor's best positives; the second takes, for each
positive, the best negatives whose scores lie in its window.

Candidates are dealt into shards and anchors, whole clusters together, into chunks of bounded size; each pair of a shard
and a chunk is a group of its own with the walk's best few per anchor for its outcome, and these are merged by anchor.
Shards are dealt by row, so no label, however frequent, weighs on one task. The clusters are fitted on at most SAMPLE
anchors (SAMPLE_BYTES of them at most); this changes how far members walk, never a result.

Rows without an id or a label, without a vector or with an empty one, with a null or non-finite component, or longer
than 2**27 units take no part. Vectors of different lengths never meet. A row is no positive of an anchor with its own
id; repeated rows are rows of their own, and each anchor row gives its own results. Ties go to smaller ids. Labels are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.attach import attach
from barloom.session import discard, written

SAMPLE, SAMPLE_BYTES = 4096, 16 << 20
CLUSTERS, PER_CLUSTER = 64, 64
#: A shard's and a chunk's components, 8 bytes each; anchors of one label and cluster that stay together; members of a walk.
SHARD, CHUNK, PIECE, BLOCK = 4 << 20, 1 << 20, 4096, 256
LONGEST = 2.0**54  # squared length: 100 times a score still fits a long
_FOUND = "anchor bigint, slot int, id bigint, score bigint"


def quantised(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, q) of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    some = rows.filter(F.col(vec_id).isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    out = some.select(F.col(vec_id).cast("bigint").alias("id"), F.xxhash64(label).alias("label"), q.alias("q"))
    return out.filter(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x) <= LONGEST)


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows of integers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one, and their lengths; the zero vector stays."""
    x = x.astype(np.float64)
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1.0)[:, None], size


def centres(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Centres of a spherical k-means over the rows of a sample."""
    unit, _ = _units(sample)
    out = unit[:clusters].copy()
    for _ in range(rounds):
        to = (unit @ out.T).argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, to, unit)
        size = np.sqrt((total * total).sum(1))
        out = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1.0)[:, None], out)
    return out


def clustered(anchors: DataFrame, chunks: int) -> DataFrame:
    """The anchors with `cluster` and `chunk`."""
    length = anchors.select(F.size("q").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    width = length["d"] if length else 1
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    sample = anchors.filter(F.size("q") == width).orderBy(F.xxhash64("anchor"), "anchor").limit(most).select("q").toArrow()
    at = centres(_matrix(sample.column("q")), max(1, min(CLUSTERS, sample.num_rows // PER_CLUSTER))) if sample.num_rows else np.zeros((1, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("q")
            cluster = np.zeros(len(q), dtype=np.int32)
            fits = np.flatnonzero(q.value_lengths().to_numpy() == width)
            if len(fits):
                cluster[fits] = (_units(_matrix(q.take(pa.array(fits))))[0] @ at.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster)], [*b.schema.names, "cluster"])

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in anchors.schema)}, cluster int"
    out = written(anchors.mapInArrow(assign, schema))
    keys = ["label", "cluster"]
    counts = out.groupBy(*keys).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_pieces"))
    part = F.pmod(F.xxhash64("anchor"), F.col("_pieces"))
    chunk = F.pmod(F.xxhash64(*keys, part), F.lit(chunks)).cast("int")
    return attach(out, counts, keys).select(*out.columns, chunk.alias("chunk"))


def _walk(members: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(member, slot, id, score) of the best k candidates of every member and slot with scores from low to high."""
    unit, size = _units(members)
    centre = unit.sum(0)
    centre /= max(np.sqrt(centre @ centre), 1e-300)
    angle = lambda c: np.arccos(np.clip(c, -1.0, 1.0))
    there, length = _units(x)
    bound = length * np.cos(np.maximum(0.0, angle(there @ centre) - angle(unit @ centre).max()))
    by = np.argsort(-bound, kind="stable")
    # rounding of the angles is far below one part in 10**7; the list stays sorted by what it certifies
    bound = np.maximum.accumulate((bound + 1e-7 * length)[by][::-1])[::-1]
    exact = size.max() * length.max() < 2.0**52
    a, x, ids = members.astype(np.float64) if exact else members, (x.astype(np.float64) if exact else x)[by], ids[by]
    wanted = np.where(low <= high, low, np.iinfo(np.int64).max)
    kept = [tuple(np.zeros(0, dtype=np.int64) for _ in range(3)) for _ in range(low.shape[1])]
    live, at, step = np.arange(len(members)), 0, 128
    while at < len(x):
        live = live[wanted[live].min(1) <= size[live] * bound[at] + 1e-3]
        if not len(live):
            break
        score = (a[live] @ x[at : at + step].T).astype(np.int64)
        other = own[live][:, None] != ids[at : at + step][None, :]
        for s in range(low.shape[1]):
            r, c = np.nonzero((score >= wanted[live, s][:, None]) & (score <= high[live, s][:, None]) & other)
            if not len(r):
                continue
            m, v, i = (np.concatenate(z) for z in zip(kept[s], (live[r], score[r, c], ids[at + c])))
            order = np.lexsort((i, -v, m))
            m, v, i = m[order], v[order], i[order]
            nth = np.arange(len(m)) - np.searchsorted(m, m)
            kept[s] = m[nth < k], v[nth < k], i[nth < k]
            last = nth == k - 1
            wanted[m[last], s] = np.maximum(wanted[m[last], s], v[last])
        at, step = at + step, min(2 * step, 2048)
    for s, (m, v, i) in enumerate(kept):
        yield m, np.full(len(m), s, dtype=np.int32), i, v


def _searched(same: bool, k: int):
    """The walks of all clusters of a chunk over a shard: candidates of their own label, or all others."""

    def run(shard: pa.Table, chunk: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        column = lambda t, c: t.column(c).to_numpy()
        widths = [t.column("q").combine_chunks().value_lengths().to_numpy() for t in (shard, chunk)]
        for d in np.unique(widths[1]) if len(shard) else ():
            rows, anchors = (t.filter(pa.array(w == d)) for t, w in zip((shard, chunk), widths))
            if not len(rows):
                continue
            x, ids, labels = _matrix(rows.column("q")), column(rows, "id"), column(rows, "label")
            q, own, label, cluster = _matrix(anchors.column("q")), column(anchors, "id"), column(anchors, "label"), column(anchors, "cluster")
            key = column(anchors, "anchor")
            low, high = (_matrix(anchors.column(c)) for c in ("low", "high"))
            order = np.lexsort((key, cluster, label))
            new = np.flatnonzero(np.diff(label[order], prepend=~label[order[0]]) | np.diff(cluster[order], prepend=-1))
            for begin, end in zip(new, np.append(new[1:], len(order))):
                fits = np.flatnonzero((labels == label[order[begin]]) == same)
                for at in range(begin, end, BLOCK) if len(fits) else ():
                    rows_of = order[at : min(at + BLOCK, end)]
                    for m, s, i, v in _walk(q[rows_of], own[rows_of], x[fits], ids[fits], low[rows_of], high[rows_of], k):
                        found.append((key[rows_of][m], s, i, v))
        none = [np.zeros(0, dtype=t) for t in (np.int64, np.int32, np.int64, np.int64)]
        return pa.table([np.concatenate(c) for c in zip(none, *found)], ["anchor", "slot", "id", "score"])

    return run


def _best(rows: DataFrame, anchors: DataFrame, shards: int, chunks: int, same: bool, k: int) -> DataFrame:
    """(anchor, slot, id, score, nth): the best k over all shards."""
    left = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(_searched(same, k), _FOUND)
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return met.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    label: Column | str = "label",
    vec_id: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor and each of its best
    `positives` rows of the same label, the best `negatives` rows of other labels with scores from `low` to `high` percent
    of the positive's, the best first. `is_anchor` is a condition on `id`, the id as a long."""
    label = F.col(label) if isinstance(label, str) else label
    table = written(quantised(rows, vec_id, vector, label, scale).withColumn("anchor", F.monotonically_increasing_id()))
    weigh = F.coalesce(F.sum(F.size("q")), F.lit(0)), F.count("*")
    n, rows_n = table.agg(*weigh).first()
    shards = max(1, -(-n // SHARD), min(48, rows_n // 512))
    cut = table.select("id", "label", "q", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"))
    asking = table.filter(is_anchor)
    chunks = max(1, -(-asking.agg(*weigh).first()[0] // CHUNK))
    any_score = lambda v: F.array(F.lit(v).cast("bigint"))
    anchors = written(clustered(asking, chunks))
    first = _best(cut, anchors.withColumns({"low": any_score(-(2**62)), "high": any_score(2**62)}), shards, chunks, True, positives)
    best = written(first.select("anchor", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    per = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("p"))  # at most `positives`
    share = lambda pct, to: F.expr(f"transform(p, x -> ({pct} * x.positive_score {to}) div 100)")  # noqa: E731  whole hundreds, up or down
    windows = per.select("anchor", share(low, f"+ pmod(-{low} * x.positive_score, 100)").alias("low"), share(high, f"- pmod({high} * x.positive_score, 100)").alias("high"))
    # an anchor has at most `positives` slots; those it lacks are empty windows
    fill = lambda c, v: F.slice(F.concat(c, F.array_repeat(F.lit(v).cast("bigint"), positives)), 1, positives).alias(c)
    second = anchors.join(windows, "anchor").select(*anchors.columns, fill("low", 1), fill("high", 0))
    worst = _best(cut, second, shards, chunks, False, negatives).select("anchor", (F.col("slot") + 1).alias("nth"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("nth").alias("rank"))
    named = best.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    out = written(worst.join(named, ["anchor", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    for used in (table, anchors, best):
        discard(used)
    return out
