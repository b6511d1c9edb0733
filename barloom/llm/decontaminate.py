"""Benchmark decontamination with suffix arrays of the training documents.

A shard is a run of whole documents of one partition. Its words become numbers in order of their hashes, all suffixes of
the shard are sorted (the first words packed into one key, then rank doubling over the ties), and every suffix of every
benchmark text is binary-searched in the array: the neighbours of its place give the longest verbatim match and where it
lies, and the range that shares a whole window gives every place where that window occurs. Shards never need each other,
so nothing is shuffled; benchmark texts travel in blocks of bounded size and each block is one pass.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words are runs
without ASCII characters other than letters and digits, lower-cased A-Z. Null and wordless texts match nothing; repeated
rows are judged one by one. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import _NOT_ALNUM, Words, released, text_slices
from barloom.session import written

WINDOW = 10
BLOCK_WORDS = 200_000
SHARD_BYTES = 2 << 20
CHUNK = 8192
PASSES = 8


def _item_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return Words(raw, np.array([0, len(raw)]), _NOT_ALNUM).hash


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, int, int, np.ndarray]]]:
    """Blocks of (item id as text, offset, words in the item, hashes of the words), each of about `block_words` words.

    Items come partition by partition. An item longer than CHUNK words comes in pieces that share window - 1 words,
    so that every window stands in one piece.
    """
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        h = _item_words(row[1])
        for at in range(0, max(1, len(h) - window + 1), CHUNK):
            piece = h[at : at + CHUNK + window - 1]
            if len(piece):
                block.append((row[0], at, len(h), piece))
                size += len(piece)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


class _Queries:
    """All suffixes of a block's texts: one array of hashes with the end of each text."""

    def __init__(self, block: list, window: int):
        self.items = [b[0] for b in block]
        self.words = np.concatenate([b[3] for b in block] + [np.zeros(0, np.uint64)])
        sizes = np.array([len(b[3]) for b in block], dtype=np.int64)
        self.item = np.repeat(np.arange(len(block)), sizes)
        self.end = np.repeat(np.cumsum(sizes), sizes)
        self.offset = np.arange(len(self.words)) - (self.end - np.repeat(sizes, sizes)) + np.repeat([b[1] for b in block], sizes)
        self.need = np.repeat(np.minimum([b[2] for b in block], window), sizes)
        self.longest = int(sizes.max(initial=0))


class SuffixArray:
    """Suffixes of a shard in order. `code` holds a rank per word; 0 separates documents and matches nothing."""

    def __init__(self, hashes: np.ndarray, document: np.ndarray, depth: int):
        self.alphabet, codes = np.unique(hashes, return_inverse=True)
        n_docs = int(document[-1]) + 1 if len(document) else 0
        self.place = np.arange(len(codes)) + document  # one separator after each document
        self.code = np.zeros(len(codes) + n_docs + 1, dtype=np.int64)
        self.code[self.place] = codes + 1
        self.word = np.full(len(self.code), -1, dtype=np.int64)
        self.word[self.place] = np.arange(len(codes))
        self.order = self._sort(depth)

    def _sort(self, depth: int) -> np.ndarray:
        bits = max(1, int(len(self.alphabet)).bit_length())
        take = min(max(1, 62 // bits), len(self.code))
        key = np.zeros(len(self.code), dtype=np.int64)
        for k in range(take):
            key <<= bits
            key[: len(key) - k] |= self.code[k:]
        order = np.argsort(key)
        same = np.zeros(len(order), dtype=bool)
        same[1:] = key[order[1:]] == key[order[:-1]]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        done = take
        while done < depth:
            tied = same.copy()
            tied[:-1] |= same[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            rows = order[at]
            head = rank[rows]
            to = rows + done
            next_ = np.where(to < len(rank), rank[np.minimum(to, len(rank) - 1)], -1)
            by = np.lexsort((next_, head))
            order[at] = rows[by]
            head, next_ = head[by], next_[by]
            equal = np.zeros(len(at), dtype=bool)
            equal[1:] = (head[1:] == head[:-1]) & (next_[1:] == next_[:-1])
            same[at] = equal
            ranks = np.maximum.accumulate(np.where(equal, 0, at))
            rank[rows[by]] = ranks
            done *= 2
        return order

    def _common(self, suffix: np.ndarray, codes: np.ndarray, start: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that suffixes share with queries (at most `most`), and whether the suffix is below the query there."""
        shared, below = np.zeros(len(suffix), dtype=np.int64), np.zeros(len(suffix), dtype=bool)
        live = np.arange(len(suffix))
        k = 0
        while len(live):
            live = live[k < most[live]]
            at = suffix[live] + k
            here = np.where(at < len(self.code), self.code[np.minimum(at, len(self.code) - 1)], -1)
            there = codes[start[live] + k]
            equal = 2 * here == there
            out = ~equal
            below[live[out]] = 2 * here[out] < there[out]
            live = live[equal]
            k += 1
            shared[live] = k
        return shared, below

    def search(self, codes: np.ndarray, start: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
        """Place of each query of `most` words: before (or after) the suffixes that begin with it."""
        lo, hi = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(self.order), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            shared, below = self._common(self.order[mid], codes, start[open_], most[open_])
            right = below | (after & (shared == most[open_]))
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Twice the rank of each word; odd, between its neighbours, where the shard lacks it."""
        at = np.searchsorted(self.alphabet, hashes)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == hashes[known]
        return np.where(known, 2 * (at + 1), 2 * at + 1)


def _match(words: Words, q: _Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Per hit window occurrence (first word in the shard, length, item), and the longest match of every query suffix that
    a window begins: (query position, length, word in the shard)."""
    sa = SuffixArray(words.hash, words.text, q.longest + 1)
    codes = sa.encode(q.words)
    # a suffix whose first word the shard lacks has no match at all; the rest is searched with all its words
    start = np.flatnonzero((codes % 2 == 0) & (q.end - np.arange(len(codes)) >= q.need))
    full, need = q.end[start] - start, q.need[start]
    place = sa.search(codes, start, full, False)
    best, where = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
    for side in (-1, 0):
        at = place + side
        ok = np.flatnonzero((at >= 0) & (at < len(sa.order)))
        shared, _ = sa._common(sa.order[at[ok]], codes, start[ok], full[ok])
        better = shared > best[ok]
        best[ok[better]], where[ok[better]] = shared[better], sa.order[at[ok[better]]]
    hit = np.flatnonzero(best >= need)
    lo = sa.search(codes, start[hit], need[hit], False)
    hi = sa.search(codes, start[hit], need[hit], True)
    n = hi - lo
    rows = np.repeat(np.arange(len(hit)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return sa.word[sa.order[at]], need[hit][rows], q.item[start[hit]][rows], [start[hit], best[hit], sa.word[where[hit]]]


def _hits(words: Words, q: _Queries) -> Iterator[tuple[np.ndarray, list[str], list[tuple]]]:
    """Per text of the slice: a mask of its hit words, and the items with occurring windows."""
    mask = np.zeros(len(words.start) + 1, dtype=np.int64)
    items: list[set] = [set() for _ in range(words.n_texts)]
    if len(words.hash) and len(q.words):
        first, length, item, _ = _match(words, q)
        np.add.at(mask, first, 1)
        np.add.at(mask, first + length, -1)
        for t, i in np.unique(np.stack([words.text[first], item]), axis=1).T if len(first) else ():
            items[t].add(q.items[i])
    return np.cumsum(mask)[:-1] > 0, items


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row as `doc` with n_words, `spans` (hit runs of words as begin, end pairs in one array) and `items`."""
    row = F.struct(*[docs[c] for c in docs.columns])
    out = docs.select(row.alias("doc"), F.col(text).alias("_t"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    sc = docs.sparkSession.sparkContext
    sent = []
    blocks = benchmark_blocks(benchmark, item_id, item_text, window, block_words)
    for block in chain([next(blocks, [])], blocks):
        if len(sent) == PASSES:  # a long benchmark goes in several jobs, and the driver holds few blocks at a time
            out = written(out)
            for done in sent:
                done.destroy()
            sent = []
        sent.append(sc.broadcast(_Queries(block, window)))
        out = out.mapInArrow(released(_pass(sent[-1])), schema)
    return out.drop("_t")


def _pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            for at, to, raw, bounds in text_slices(b.column("_t"), SHARD_BYTES):
                part = b.slice(at, to - at)
                words = Words(raw, bounds, _NOT_ALNUM)
                mask, items = _hits(words, q)
                before, had = part.column("spans"), part.column("items")
                spans, names = [], []
                touched = np.zeros(words.n_texts, dtype=bool)
                touched[words.text[mask]] = True
                for i in range(words.n_texts):
                    if not touched[i] and not items[i]:
                        spans.append(before[i].as_py()), names.append(had[i].as_py())
                        continue
                    own = mask[words.offsets[i] : words.offsets[i + 1]].copy()
                    for a, e in zip(*[iter(before[i].as_py())] * 2):
                        own[a:e] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    spans.append(edge.tolist()), names.append(sorted({*had[i].as_py(), *items[i]}, key=lambda s: (s is not None, s)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("_t"), pa.array(np.diff(words.offsets)), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))],
                    ["doc", "_t", "n_words", "spans", "items"],
                )

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, item_word, length, doc_id, doc_word): of every benchmark suffix that begins with a window found in a
    shard, the longest verbatim match there and one place of it; the largest over shards is one aggregation away."""
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    kind = rows.schema["d"].dataType.simpleString()
    sc, out = docs.sparkSession.sparkContext, None

    def run_with(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            for b in batches:
                for at, _, raw, bounds in text_slices(b.column("t"), SHARD_BYTES):
                    words = Words(raw, bounds, _NOT_ALNUM)
                    if not len(words.hash) or not len(q.words):
                        continue
                    _, _, _, (start, length, place) = _match(words, q)
                    t = words.text[place]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([q.items[i] for i in q.item[start]], pa.string()), pa.array(q.offset[start]), pa.array(length), b.column("d").take(pa.array(t + at)), pa.array(place - words.offsets[t])],
                        ["item_id", "item_word", "length", "doc_id", "doc_word"],
                    )

        return run

    for block in [*benchmark_blocks(benchmark, item_id, item_text, window)] or [[]]:
        found = rows.mapInArrow(released(run_with(sc.broadcast(_Queries(block, window)))), f"item_id string, item_word bigint, length bigint, doc_id {kind}, doc_word bigint")
        out = found if out is None else out.union(found)
    return out


def digest(items: list[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(i or "" for i in items)).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents without a hit word, with their own columns."""
    return mark(docs, benchmark, **names).filter(F.size("spans") == 0).select("doc.*")
