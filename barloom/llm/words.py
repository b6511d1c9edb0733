"""Words and their 64-bit hashes, for whole columns of texts at a time; and small native text helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t-\r]"  # \x20 and \x09-\x0D
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NOT_ALNUM = np.zeros(256, dtype=bool)
_NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _MASK = 0x9E3779B97F4A7C15 | 5, 2**64 - 1
_INVERSE = pow(_BASE, -1, 2**64)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES + "+", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+"))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    return out[:n]


#: Powers inside a block of bytes; a block's own offset is one factor more, so no table grows with a text.
_STEP = 1 << 16
_POWERS = _powers(_BASE, _STEP), _powers(_INVERSE, _STEP)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits, one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a slice of texts: which text, where its bytes begin and end, and a hash.

    Letters A-Z are lower-cased unless told otherwise. Equal words have equal hashes; different ones differ but for
    a chance of about 2**-64 a pair.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, separator: np.ndarray = _IS_SPACE, lower: bool = True):
        self.n_texts = len(bounds) - 1
        self.raw = raw = _LOWER[raw] if lower else raw
        inside = ~separator[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = bounds[:-1][bounds[:-1] < len(raw)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        last[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, bounds)
        self.text = np.repeat(np.arange(self.n_texts), np.diff(self.offsets))

    @cached_property
    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def within(self, which: np.ndarray) -> np.ndarray:
        """Marks the bytes of the chosen words."""
        change = np.zeros(len(self.raw) + 1, dtype=np.int8)
        change[self.start[which]] += 1
        change[self.end[which]] -= 1
        return np.cumsum(change[:-1], dtype=np.int8) > 0

    def cut(self, raw: np.ndarray, starts: np.ndarray) -> Words:
        """The same texts with `raw` for their bytes and further cuts inside words: `starts` marks first bytes."""
        out = copy(self)
        vars(out).pop("hash", None), vars(out).pop("_cum", None)
        out.raw = raw
        word = np.zeros(len(raw), dtype=bool)
        word[self.start] = True
        out.start = np.flatnonzero(starts | word)
        first = np.append(np.flatnonzero(word[out.start]), len(out.start))  # of each word's pieces
        out.end = np.append(out.start[1:], 0)
        out.end[first[1:] - 1] = self.end
        out.offsets = first[self.offsets]
        out.text = np.repeat(np.arange(self.n_texts), np.diff(out.offsets))
        return out

    def _sums(self) -> np.ndarray:
        if not hasattr(self, "_cum"):
            n = len(self.raw)
            self._cum = cum = np.zeros(n + 1, dtype=np.uint64)
            for at in range(0, n, _STEP):
                part = self.raw[at : at + _STEP].astype(np.uint64)
                part += np.uint64(1)
                part *= _POWERS[0][: len(part)]
                part *= np.uint64(pow(_BASE, at, 2**64))
                np.cumsum(part, out=cum[at + 1 : at + 1 + len(part)])
                cum[at + 1 : at + 1 + len(part)] += cum[at]
        return self._cum

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        cum = self._sums()
        shift = np.array([pow(_INVERSE, at, 2**64) for at in range(0, len(self.raw) + 1, _STEP)], dtype=np.uint64)
        return mix((cum[end] - cum[start]) * _POWERS[1][start & (_STEP - 1)] * shift[start // _STEP])


def text_slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of slices of about `limit` bytes; a longer text is one slice. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        to = min(to, len(column))
        yield at, to, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def released(run: Callable) -> Callable:
    """The function of a mapInArrow, after which the worker's free memory goes back to the system: workers wait for further tasks
    beside those that work, and would keep what their largest batch took. An empty batch comes last, as Spark holds the last one
    and columns of it may hold all of the input's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for out in run(batches):
            schema = out.schema
            yield out
        out = None
        if schema is not None:
            yield pa.RecordBatch.from_pylist([], schema)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return wrapped


class Lookup:
    """Positions of 64-bit keys in a table of distinct keys; -1 for others. `room`: keys in all, with those added later."""

    def __init__(self, keys: np.ndarray, room: int = 0):
        room = max(room, len(keys))
        size = 1 << max(4, (2 * room + 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.slot, self.keys, self.n = np.full(size, -1, dtype=np.int32), np.empty(room, dtype=np.uint64), 0
        self.add(keys)

    def add(self, keys: np.ndarray) -> None:
        """Further keys, none of them in the table."""
        left = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.keys[self.n : self.n + len(keys)] = keys
        self.n += len(keys)
        at = self.keys[left] & self.mask
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + np.uint64(1)) & self.mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int32)
        if not self.n:
            return out
        rows, at = None, h & self.mask
        while len(at):
            s = self.slot[at]
            hit = (s >= 0) & (self.keys[s] == h)
            if rows is None:
                out[hit] = s[hit]
                rows = np.flatnonzero((s >= 0) & ~hit)
            else:
                out[rows[hit]] = s[hit]
                keep = (s >= 0) & ~hit
                rows = rows[keep]
            more = (s >= 0) & ~hit
            h, at = h[more], (at[more] + np.uint64(1)) & self.mask
        return out
