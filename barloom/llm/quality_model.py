"""Document quality by a factorisation machine.

Features of a document: its words hashed into BUCKETS (weight log(1 + count), scaled to unit length), and bins of
structure and metadata measurements (length, shares of symbols and capitals, words said twice, ...), one active bin a measurement.
The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),

whose pair sum takes linear time. The machine is fitted on the driver by Adagrad over at most `sample` labelled
documents, those of least id hash (a documented bound); scoring is one pass without a shuffle. A null or empty text has
no words and the lowest bins; every row gets a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import Words, text_slices

BUCKETS = 1 << 14
FACTORS = 8
SAMPLE = 8000
BINS = 12
#: Of bytes: 1 letters and non-ASCII, 2 digits, 3 spaces, 4 sentence marks, 5 other.
_CLASSES = np.full(256, 5, dtype=np.int64)
_CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASSES[48:58] = 2
_CLASSES[[9, 10, 11, 12, 13, 32]] = 3
_CLASSES[[33, 34, 39, 44, 46, 58, 59, 63]] = 4
MEASURES = 10
WIDTH = BUCKETS + MEASURES * BINS


def _bin(x: np.ndarray) -> np.ndarray:
    """Shares in [0, 1] into bins that are finer near zero."""
    return np.minimum(BINS - 1, np.ceil(np.sqrt(np.clip(x, 0, 1)) * (BINS - 1))).astype(np.int64)


def features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of the texts of a slice, in order of document and feature."""
    words = Words(raw, bounds)
    n = words.n_texts
    key, count = np.unique(words.text * BUCKETS + (words.hash >> np.uint64(50)).astype(np.int64), return_counts=True)
    doc, value = key // BUCKETS, np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=n))
    value = value / norm[doc]
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 6 + _CLASSES[raw], minlength=6 * n).reshape(n, 6)
    n_words = np.bincount(words.text, minlength=n)
    per = lambda a, b: a / np.maximum(b, 1)
    used = np.bincount(doc, minlength=n)
    twice = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    lines = np.bincount(owner[raw == 10], minlength=n) + 1
    measures = [
        _bin(np.log1p(n_words) / 12), _bin(per(kinds[:, 5], size)), _bin(per(kinds[:, 2], size)), _bin(per(kinds[:, 4], n_words)),
        _bin(per(size, n_words) / 40), _bin(per(used, n_words)), _bin(per(lines, n_words)), _bin(np.log1p(size) / 16),
        _bin(per(np.bincount(owner[(raw >= 65) & (raw <= 90)], minlength=n), kinds[:, 1])), _bin(per(np.bincount(words.text[1:][twice], minlength=n), n_words)),
    ]
    extra = np.stack([BUCKETS + m * BINS + b for m, b in enumerate(measures)], axis=1)
    docs = np.concatenate([doc, np.repeat(np.arange(n), MEASURES)])
    index = np.concatenate([key % BUCKETS, extra.ravel()])
    values = np.concatenate([value, np.full(n * MEASURES, 0.5)])
    order = np.argsort(docs, kind="stable")
    return docs[order], index[order], values[order]


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        doc, i, x = features(raw, bounds)
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        vx = self.factors[i] * x[:, None]
        z = self.bias + np.add.reduceat(self.weights[i] * x, at)
        z += 0.5 * (np.add.reduceat(vx, at, axis=0) ** 2 - np.add.reduceat(vx * vx, at, axis=0)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str | None], labels: np.ndarray, factors: int = FACTORS, epochs: int = 6, batch: int = 64, rate: float = 0.1, ridge: float = 1e-5, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, with the two classes weighted alike. Without labels of both kinds: the share of ones."""
    share = float(labels.mean()) if len(labels) else 0.5
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, factors)))
    if share in (0.0, 1.0) or not len(labels):
        m.bias, m.factors = float(np.log((share + 0.01) / (1.01 - share))), np.zeros_like(m.factors)
        return m
    rows = []
    for _, _, raw, bounds in text_slices(pa.array(texts, pa.large_string())):
        doc, i, x = features(raw, bounds)
        cut = np.searchsorted(doc, np.arange(len(bounds)))
        rows += [(i[a:b], x[a:b]) for a, b in zip(cut, cut[1:])]
    gw, gv, gb = np.full(WIDTH, 1e-6), np.full((WIDTH, factors), 1e-6), 1e-6
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            i, x = np.concatenate([rows[k][0] for k in some]), np.concatenate([rows[k][1] for k in some])
            size = np.array([len(rows[k][0]) for k in some])
            first, own = np.cumsum(size) - size, np.repeat(np.arange(len(some)), size)
            vx = m.factors[i] * x[:, None]
            total = np.add.reduceat(vx, first, axis=0)
            z = m.bias + np.add.reduceat(m.weights[i] * x, first) + 0.5 * (total**2 - np.add.reduceat(vx * vx, first, axis=0)).sum(1)
            slope = weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            used, place = np.unique(i, return_inverse=True)
            sx = slope[own] * x
            dw = np.bincount(place, sx, minlength=len(used)) + ridge * m.weights[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, place, sx[:, None] * (total[own] - vx))
            dv += ridge * m.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += slope.sum() ** 2
            m.weights[used] -= rate * dw / np.sqrt(gw[used])
            m.factors[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            m.bias -= rate * slope.sum() / np.sqrt(gb)
    return m


def sample(docs: DataFrame, labels: DataFrame, keep: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", bound: int = SAMPLE) -> tuple[list[str | None], np.ndarray]:
    """At most `bound` labelled documents that satisfy `keep`, those of least id hash, with their labels."""
    own = docs.filter(keep).select(F.col(doc_id).alias("_d"), F.col(text).alias("_t"))
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_d")).agg(F.max(label).alias("_y"))
    # the labels alone settle which documents are taken; their texts follow
    ids = own.select("_d").distinct().join(marks, "_d").orderBy(F.xxhash64("_d"), "_d").limit(bound)
    rows = own.join(F.broadcast(ids), "_d").orderBy(F.xxhash64("_d"), "_d").limit(bound).select("_t", "_y").toPandas()
    return [t if isinstance(t, str) else None for t in rows["_t"]], rows["_y"].to_numpy(dtype=float)


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """Every row as `doc`, with `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, raw, bounds in text_slices(b.column("_t")):
                yield pa.RecordBatch.from_arrays([b.column("doc").slice(at, to - at), pa.array(shared.value.score(raw, bounds))], ["doc", "score"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, score double")
