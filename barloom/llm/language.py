"""Languages of texts and of spans inside them.

Scripts come first: a word's code points fall into ranges, and only languages seen with its script are candidates. A
candidate's score of the word is the log-probability of its byte trigrams (with the spaces around it) and of the word as a whole,
hashed into tables. Viterbi over the words, with a penalty for each switch, labels the spans; a text's language is the one with
the most bytes of words. Texts in which no stretch of words could pay for a switch skip the walk, which gives the same path.

Tables are counted on a documented bound of labelled documents, over all of Spark: of each language those with the least id hashes,
as its share of `sample` but about LEAST_DOCS or all it has, so every label is learned. Tables take half a megabyte a label.
Scoring is one pass without a shuffle. Null texts and texts without a letter are `und` with score 0. Texts whose words belong to no
learned script get the most frequent language and score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import Words, text_slices
from barloom.session import written

#: Script ranges by first code point, in order; 0 is none (signs, digits, marks).
SCRIPTS = (
    (0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 2), (0xB6, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1),
    (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 12),
    (0x13A0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 13), (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 14), (0xFB00, 1), (0xFB13, 0), (0x20000, 14), (0x30000, 0),
)
_FROM = np.array([a for a, _ in SCRIPTS], dtype=np.int64)
_BIT = np.array([1 << s >> 1 if s else 0 for _, s in SCRIPTS], dtype=np.int64)
BUCKETS = 1 << 16
SAMPLE = 20_000
LEAST_DOCS = 200
AT_ONCE = 16  # labels held at a time where rows by labels would be large
SWITCH = 12.0
WORD_WEIGHT = 1.0


def _scripts(w: Words) -> np.ndarray:
    """Bit set of the scripts of each word's letters."""
    raw = w.raw
    bits = np.zeros(len(raw), dtype=np.int64)
    bits[(raw >= 97) & (raw <= 122)] = 1
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        at = lambda k: raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int64) & 0x3F
        b = raw[lead].astype(np.int64)
        cp = np.where(b < 0xE0, (b & 0x1F) << 6 | at(1), np.where(b < 0xF0, (b & 0x0F) << 12 | at(1) << 6 | at(2), (b & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        bits[lead] = _BIT[np.searchsorted(_FROM, cp, side="right") - 1]
    return np.bitwise_or.reduceat(bits, w.start) if len(w.start) else np.zeros(0, np.int64)  # spaces between words carry none


def _trigrams(w: Words) -> np.ndarray:
    """Bucket of the three bytes around each byte, with spaces for whatever parts words."""
    b = np.full(len(w.raw) + 2, 32, dtype=np.uint32)
    b[1:-1] = np.where(w.raw < 33, 32, w.raw)
    key = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return (key >> np.uint32(16)).astype(np.int32)


def _word_bucket(w: Words) -> np.ndarray:
    return (w.hash >> np.uint64(48)).astype(np.int32)


def _limit(m: Model) -> int:
    """Bytes of a slice, fewer where there are many labels."""
    return max(1 << 14, (1 << 20) // max(1, len(m.names) // AT_ONCE))


def _slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """Slices with one space put after each text, so that trigrams never cross texts; with the plain bytes."""
    for at, to, raw, bounds in text_slices(column, limit):
        n = to - at
        out = np.full(len(raw) + n, 32, dtype=np.uint8)
        own = np.repeat(np.arange(n), np.diff(bounds))
        out[np.arange(len(raw)) + own] = raw
        yield at, to, Words(out, bounds + np.arange(n + 1)), out


@dataclass
class Model:
    names: list[str]
    scripts: np.ndarray  # bit set of each language
    grams: np.ndarray  # buckets by languages
    whole: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): trigrams, words from BUCKETS on, scripts from 2 * BUCKETS on."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        names = np.array(b.column("lang").to_pylist(), dtype=object)
        for name in set(names):
            rows = pa.array(np.flatnonzero(names == name))
            total = sums.setdefault(name, np.zeros(2 * BUCKETS + 16, dtype=np.int64))
            for _, _, w, _ in _slices(b.column("t").take(rows)):
                total[:BUCKETS] += np.bincount(_trigrams(w), minlength=BUCKETS)
                total[BUCKETS : 2 * BUCKETS] += np.bincount(_word_bucket(w), minlength=BUCKETS)
                s = _scripts(w)
                total[2 * BUCKETS :] += np.array([(s >> k & 1).sum() for k in range(16)])
    for name, total in sums.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Tables from labelled documents: all up to `sample`, beyond that a share of about `sample` by id hash, and LEAST_DOCS a language."""
    rows = docs.filter(training & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)).alias("h"))
    rows = rows.filter(F.col("t").rlike(r"[^ \t-\r]"))
    per_lang = written(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")))
    n = per_lang.agg(F.sum("n")).first()[0] or 0
    if n > sample:
        rate = F.greatest(F.lit(sample / n), F.lit(float(LEAST_DOCS)) / F.col("n"))
        cuts = per_lang.select("lang", F.greatest(F.col("least") + 1, F.least(rate, F.lit(1.0)) * (1 << 30)).alias("cut"))
        rows = rows.join(F.broadcast(cuts), "lang").filter("h < cut")
    rows = rows.select("lang", "t")
    sums = rows.mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = written(sums)
    sizes = sums.filter(F.col("bucket") < BUCKETS).groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").toPandas()  # one row a label
    names = sizes["lang"].tolist()
    counts = np.zeros((2 * BUCKETS + 16, len(names)))
    for at in range(0, len(names), AT_ONCE):
        table = sums.filter(F.col("lang").isin(names[at : at + AT_ONCE])).toPandas()  # at most 2 * BUCKETS + 16 rows a language
        for k, name in enumerate(names[at : at + AT_ONCE], at):
            own = table[table["lang"] == name]
            counts[own["bucket"], k] = own["n"]
    log = lambda c: np.log((c + 0.5) / (c.sum(0) + 0.5 * len(c))).astype(np.float32)
    found = counts[2 * BUCKETS :]
    scripts = ((found > 0.01 * found.sum(0)) * (1 << np.arange(16))[:, None]).sum(0).astype(np.int64)
    grams, whole = log(counts[:BUCKETS]), log(counts[BUCKETS : 2 * BUCKETS])
    # differences matter, not levels: against the mean of the languages, so that long words weigh no more for being long
    if names:
        grams, whole = grams - grams.mean(1, keepdims=True), whole - whole.mean(1, keepdims=True)
    return Model(names, scripts, grams, whole)


def word_scores(m: Model, w: Words, scripts: np.ndarray) -> np.ndarray:
    if not len(w.start):
        return np.zeros((0, len(m.names)))
    s, gram, whole = np.empty((len(w.start), len(m.names))), _trigrams(w), _word_bucket(w)
    for at in range(0, len(m.names), AT_ONCE):
        some = slice(at, min(at + AT_ONCE, len(m.names)))
        cum = np.zeros((len(w.raw) + 1, some.stop - at))
        np.cumsum(m.grams[:, some][gram], axis=0, out=cum[1:], dtype=np.float64)
        s[:, some] = cum[w.end] - cum[w.start] + WORD_WEIGHT * m.whole[:, some][whole]
    fits = (scripts[:, None] & m.scripts) != 0
    none = ~fits.any(1)
    s[~fits] = s.min() - 30.0
    s[none] = 0
    return s


def _needs_walk(s: np.ndarray, text: np.ndarray, offsets: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Texts where some stretch of words favours another language than the best by more than one switch costs."""
    n = len(total)
    best = total.argmax(1)
    far = 4 * (np.abs(s).sum() + 1)
    out = np.zeros(n, dtype=bool)
    if not len(s):
        return out
    for k in range(s.shape[1]):
        gain = s[:, k] - s[np.arange(len(s)), best[text]]
        c = np.cumsum(gain) - text * 1.0e6
        before = np.concatenate([[0.0], np.cumsum(gain)[:-1]]) - text * 1.0e6
        low = np.minimum.accumulate(before)
        out |= np.maximum.reduceat(np.append(c - low, -far), np.minimum(offsets[:-1], len(s))) * (np.diff(offsets) > 0) > SWITCH
    return out


def _walk(s: np.ndarray, first: np.ndarray, size: np.ndarray, switch: float) -> list[np.ndarray]:
    """Best path of each text, all texts in step, longest first."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    k = s.shape[1]
    kind = np.int8 if k <= 128 else np.int32
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    value = s[first].copy()
    came = [np.zeros((len(first), k), dtype=kind)]
    for t in range(1, size[0]):
        n = live[t]
        v = value[:n]
        top = v.argmax(1)
        jump = v[np.arange(n), top] - switch
        stay = v >= jump[:, None]
        came.append(np.where(stay, np.arange(k), top[:, None]).astype(kind))
        value[:n] = np.where(stay, v, jump[:, None]) + s[first[:n] + t]
    paths: list[np.ndarray] = [np.zeros(0, kind)] * len(first)
    at = value.argmax(1)
    flat, place = np.empty(int(size.sum()), dtype=kind), np.cumsum(size) - size
    for t in range(size[0] - 1, -1, -1):
        n = live[t]
        flat[place[:n] + t] = at[:n]
        at[:n] = came[t][np.arange(n), at[:n]]
    for i, a, n in zip(order, place, size):
        paths[i] = flat[a : a + n]
    return paths


def label(m: Model, w: Words, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """Language of each word, -1 for words without letters of a learned script; and the words' scripts."""
    scripts = _scripts(w)
    if not m.names:
        return np.full(len(scripts), -1), scripts
    s = word_scores(m, w, scripts)
    path = np.zeros(len(s), dtype=np.int64)
    if len(s):
        cum = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s, axis=0)])
        total = cum[w.offsets[1:]] - cum[w.offsets[:-1]]
        path = total.argmax(1)[w.text]
        mixed = np.flatnonzero(_needs_walk(s, w.text, w.offsets, total))
        if len(mixed):
            for i, p in zip(mixed, _walk(s, w.offsets[mixed], w.offsets[mixed + 1] - w.offsets[mixed], switch)):
                path[w.offsets[i] : w.offsets[i + 1]] = p
    return np.where((scripts[:, None] & m.scripts).any(1), path, -1), scripts


def _verdicts(m: Model, w: Words, texts) -> tuple[list[str], np.ndarray]:
    path, scripts = label(m, w)
    n, k = w.n_texts, max(1, len(m.names))
    weight = (w.end - w.start) * (path >= 0)
    mass = np.bincount(w.text * k + np.maximum(path, 0), weight, minlength=n * k).reshape(n, k)
    letters = np.bincount(w.text, scripts != 0, minlength=n) > 0
    total, best = mass.sum(1), mass.argmax(1)
    names, score = [], np.where(total > 0, mass[np.arange(n), best] / np.maximum(total, 1), 0.0)
    for i in range(n):
        has = letters[i] or any(c.isalpha() for c in texts(i))
        names.append(m.names[best[i]] if has and m.names else "und")
        if names[-1] == "und":
            score[i] = 0.0
    return names, score


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row as `doc`, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("_t")
            for at, to, w, _ in _slices(column, _limit(shared.value)):
                names, score = _verdicts(shared.value, w, lambda i, at=at: column[at + i].as_py() or "")
                yield pa.RecordBatch.from_arrays([b.column("doc").slice(at, to - at), pa.array(names, pa.string()), pa.array(score)], ["doc", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row as `doc`, with `spans`: (lang, first word, end word) of each run of words in one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, w, _ in _slices(b.column("_t"), _limit(shared.value)):
                path, _ = label(shared.value, w)
                out = []
                for i in range(w.n_texts):
                    p = path[w.offsets[i] : w.offsets[i + 1]]
                    known = np.flatnonzero(p >= 0)
                    cut = np.append(True, p[known][1:] != p[known][:-1]) if len(known) else np.zeros(0, bool)
                    first = np.flatnonzero(cut)
                    last = np.append(first[1:], len(known)) - 1
                    out.append([{"lang": shared.value.names[p[known[a]]], "first": int(known[a]), "end": int(known[e]) + 1} for a, e in zip(first, last)])
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc").slice(at, to - at), pa.array(out, kind)], ["doc", "spans"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, spans array<struct<lang:string,first:bigint,end:bigint>>")
