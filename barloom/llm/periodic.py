"""Periodic runs of words, by longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period q, at least `least` words and `times` periods long, that
cannot be widened on either side with period q. Where words x and x + p agree, the stretch of agreement around x is one
longest common extension to the right and one to the left; a run with period p is such a stretch of at least
max(least - p, (times - 1) p) words. So for every p one point in that many words is asked (a harmonic grid, about two
points a word in all), and most points fail their first comparison.

Extensions: positions whose remainder modulo v lies in a difference cover are the samples, one in seven. Only sampled
suffixes are sorted (packed words first, then rank doubling in steps of v over the ties), with the common prefixes of
neighbours in a sparse table of minima. Two positions compare fewer than v words to reach samples on both sides; from
there one range minimum gives the rest. The same on the reversed words gives extensions to the left.

Texts are handled in slices inside Arrow batches, so nothing is shuffled; a longer text is a slice of its own and takes
memory in proportion to its words. Words are compared by 64-bit hashes. Null, empty and wordless texts have no runs;
repeated rows are judged one by one; all columns of the input come back inside `doc`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import Words, let, text_slices, word_array

LEAST, TIMES = 24, 3
SLICE_BYTES = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ROWS, _POINTS = 1 << 18, 1 << 20


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """Modulus v = 24 r^2 + 36 r + 13 and 6 r + 4 remainders whose differences give every remainder."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *steps])


def _shift_table(v: int, cover: np.ndarray) -> np.ndarray:
    """[i, d]: least shift after which positions i and i + d are both samples."""
    sampled = np.zeros(v, dtype=bool)
    sampled[cover] = True
    at = np.arange(v)
    here = sampled[(at[:, None] + at) % v]  # [i, shift]
    return np.stack([(here & here[(at + d) % v]).argmax(1) for d in range(v)], axis=1)


V, COVER = difference_cover(1)
_SHIFT = _shift_table(V, COVER)
_SLOT = np.full(V, -1, dtype=np.int64)
_SLOT[COVER] = np.arange(len(COVER))


class Extensions:
    """Longest common prefixes of suffixes of `code`: positive numbers, with one of its own at the end of every text."""

    def __init__(self, code: np.ndarray):
        self.code = code
        at = np.arange(-(-len(code) // V)).repeat(len(COVER)) * V + np.tile(COVER, -(-len(code) // V))
        self.samples = at[at < len(code)]
        self._sort()
        lcp = np.zeros(len(self.samples), dtype=np.int32)
        lcp[1:] = self._neighbours(self.samples[self.order[:-1]], self.samples[self.order[1:]])
        self.minima = [lcp]
        while 2 << (len(self.minima) - 1) <= len(lcp):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _index(self, at: np.ndarray) -> np.ndarray:
        return at // V * len(COVER) + _SLOT[at % V]

    def _rank_at(self, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        inside = at < len(self.code)
        out = np.full(len(at), -1, dtype=np.int64)
        out[inside] = rank[self._index(at[inside])]
        return out

    def _sort(self) -> None:
        """The order of the sampled suffixes, and ranks by their first `depth` words, then by doubling steps of V."""
        bits = max(1, int(self.code.max(initial=1)).bit_length())
        take = min(max(1, 62 // bits), len(self.code))
        packed = np.zeros(len(self.code), dtype=np.int64)
        for k in range(take):
            packed <<= bits
            packed[: len(packed) - k] |= self.code[k:]
        packed = np.append(packed, 0)
        by_words = lambda at: packed[np.minimum(at, len(self.code))]
        key = by_words(self.samples)
        self.order = order = np.argsort(key, kind="stable")
        same = np.zeros(len(order), dtype=bool)
        same[1:] = key[order[1:]] == key[order[:-1]]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))

        def refine(next_of) -> bool:
            tied = same.copy()
            tied[:-1] |= same[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                return False
            rows = order[at]
            head, then = rank[rows], next_of(self.samples[rows])
            by = np.lexsort((then, head))
            order[at], head, then = rows[by], head[by], then[by]
            equal = np.zeros(len(at), dtype=bool)
            equal[1:] = (head[1:] == head[:-1]) & (then[1:] == then[:-1])
            same[at] = equal
            rank[rows[by]] = np.maximum.accumulate(np.where(equal, 0, at))
            return True

        depth = take
        while depth < V and refine(lambda at: by_words(at + depth)):  # noqa: B023
            depth += take
        self.levels, step = [rank.copy()], V
        while refine(lambda at: self._rank_at(self.levels[-1], at + step)):  # noqa: B023
            self.levels.append(rank.copy())
            step *= 2
        self.rank = rank

    def _neighbours(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of samples: steps of V as far as ranks agree, the rest word by word."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            live, step = np.arange(len(i)), V << k
            while len(live):
                a, b = self._rank_at(self.levels[k], i[live] + out[live]), self._rank_at(self.levels[k], j[live] + out[live])
                live = live[(a == b) & (a >= 0)]
                out[live] += step
        return out + self._compare(i + out, j + out, np.full(len(i), len(self.code)))[0]

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in common, at most `most`, and which pairs reached that."""
        out, reached, live, k = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=bool), np.arange(len(i)), 0
        while len(live):
            full = k >= most[live]
            reached[live[full]] = True
            live = live[~full]
            live = live[self.code[i[live] + k] == self.code[j[live] + k]]
            k += 1
            out[live] = k
        return out, reached

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, reached = self._compare(i, j, _SHIFT[i % V, (j - i) % V])
        on = np.flatnonzero(reached)
        a, b = self.rank[self._index(i[on] + out[on])], self.rank[self._index(j[on] + out[on])]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        more = np.empty(len(on), dtype=np.int64)
        for k in np.unique(level):
            w = level == k
            more[w] = np.minimum(self.minima[k][lo[w]], self.minima[k][hi[w] - (1 << k)])
        out[on] += more
        return out


def _grid(sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, offset, period, step) of the grid's points, in blocks of bounded size."""
    periods = np.where(sizes >= least, sizes // times, 0)
    ends = np.cumsum(periods)
    for row in range(0, int(ends[-1]) if len(ends) else 0, _ROWS):
        rows = np.arange(row, min(row + _ROWS, int(ends[-1])))
        text = np.searchsorted(ends, rows, side="right")
        p = rows - (ends - periods)[text] + 1
        step = np.maximum(least - p, (times - 1) * p)
        count = -(-(sizes[text] - p) // step)
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(total, total[at] + _POINTS, side="right")) - 1)
            pick = np.repeat(np.arange(at, to), count[at:to])
            nth = np.arange(total[at], total[to]) - total[pick]
            yield text[pick], nth * step[pick], p[pick], step[pick]
            at = to


def _near(code: np.ndarray, x: np.ndarray, y: np.ndarray, sign: int, need: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether `need` words from x and y on (to the right or the left) agree inside their text."""
    live = np.arange(len(x))
    good = np.zeros(len(x), dtype=bool)
    k = 0
    while len(live):
        full = k >= need[live]
        good[live[full]] = True
        live = live[~full]
        a, b = x[live] + sign * k, y[live] + sign * k
        live = live[(a >= low[live]) & (b < high[live])]
        live = live[code[x[live] + sign * k] == code[y[live] + sign * k]]
        k += 1
    return good


def runs_of(code: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period; `code` holds the words of texts as numbers."""
    found = []
    for text, x, p, step in _grid(np.diff(offsets), least, times):
        x = x + offsets[text]
        hit = np.flatnonzero(code[x] == code[x + p])
        text, x, p = text[hit], x[hit], p[hit]
        need = np.minimum(step[hit] // 2, 8)
        low, high = offsets[text], offsets[text + 1]
        good = _near(code, x, x + p, 1, need, low, high) | _near(code, x - 1, x + p - 1, -1, need, low, high)
        found.append((text[good], x[good], p[good]))
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    if not sum(len(f[0]) for f in found):
        return none
    text, x, p = (np.concatenate(c) for c in zip(*found))
    # extensions are built over the texts that have points left, each between separators of its own
    texts = np.unique(text)
    size = np.diff(offsets)[texts]
    begin = np.cumsum(size + 1) - size
    joined = np.zeros(int(size.sum()) + len(texts) + 1, dtype=np.int64)
    joined[np.append(0, begin + size)] = int(code.max()) + 2 + np.arange(len(texts) + 1)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(begin, size) + inside] = code[np.repeat(offsets[texts], size) + inside] + 1
    which = np.searchsorted(texts, text)
    x = x - offsets[text] + begin[which]
    right = Extensions(joined)(x, x + p)
    left = Extensions(joined[::-1].copy())(len(joined) - x, len(joined) - x - p)
    length, start = right + left + p, x - left
    keep = length >= np.maximum(least, times * p)
    text, start, length, p, which = text[keep], start[keep], length[keep], p[keep], which[keep]
    by = np.lexsort((p, length, start))  # of the same stretch the smallest period
    text, start, length, p, which = text[by], start[by], length[by], p[by], which[by]
    first = np.ones(len(by), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, p = text[first], (start - begin[which])[first], length[first], p[first]
    by = np.lexsort((p, start, text))
    return text[by], start[by], length[by], p[by]


def _collapsed(words: Words, raw: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, end, text = words.start[keep], words.end[keep], words.text[keep]
    size = end - start + 1
    last = np.ones(len(text), dtype=bool)
    last[:-1] = text[1:] != text[:-1]
    size[last] -= 1  # no space after the last word of a text
    ends = np.cumsum(size)
    from_ = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    out = raw[np.minimum(from_, max(0, len(raw) - 1))].copy()
    out[ends[~last] - 1] = 32
    bytes_of = np.zeros(words.n_texts + 1, dtype=np.int64)
    np.add.at(bytes_of, text + 1, size)
    return pa.Array.from_buffers(pa.large_string(), words.n_texts, [None, pa.py_buffer(np.cumsum(bytes_of)), pa.py_buffer(out)]).cast(pa.string())


def mark(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Every row as `doc` with n_words, `runs` (start, length, period; by start, then period) and `collapsed`: the text's
    words, joined by one space, without those that a run holds after its first period."""
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col(text).alias("_t"))
    kind = out.select("doc", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, raw, bounds in text_slices(b.column("_t"), SLICE_BYTES):
                words = Words(raw, bounds, lower=False)
                n = len(words.start)
                t, start, length, period = runs_of(np.unique(words.hash, return_inverse=True)[1], words.offsets, least, times) if n else (np.zeros(0, np.int64),) * 4
                change = np.zeros(n + 1, dtype=np.int64)
                np.add.at(change, words.offsets[t] + start + period, 1)
                np.add.at(change, words.offsets[t] + start + length, -1)
                runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
                edges = pa.array(np.searchsorted(t, np.arange(words.n_texts + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").slice(at, to - at), pa.array(np.diff(words.offsets)), pa.ListArray.from_arrays(edges, runs), _collapsed(words, raw, np.cumsum(change[:-1]) == 0)],
                    ["doc", "n_words", "runs", "collapsed"],
                )

    return out.mapInArrow(run, kind)


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The documents with their own columns, runs cut down to one period; texts without runs stay as they are."""
    marks = mark(docs, text, least, times)
    return marks.select(*[F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(f"doc.`{c}`")).alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first. Null without runs."""
    none = F.lit(None).cast(RUNS[len("array<") : -1])
    longer = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(runs, none, lambda a, x: F.when(longer(a, x), x).otherwise(a))


def with_period(text: Column, seed: Column) -> Column:
    """Plants a periodic tail in one text in ten, by a 32-bit `seed` h: where h % 10 = 0, with g = h / 10, the words from
    a = g % n on repeat the p = 1 + (n - a) / (3 + g % 8) words that begin there. Others, and wordless texts, stay."""
    g = F.floor(seed / 10).cast("bigint")

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % period))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(text)

    return F.when(seed % 10 == 0, let(word_array(text), planted)).otherwise(text)
