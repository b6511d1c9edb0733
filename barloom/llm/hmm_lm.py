"""Language-model scores by a hidden Markov model over word classes.

Counting. Words of the training documents are counted by 64-bit hash. Two bounded parts of that table travel by
broadcast: words with at least one token in KNOWN (so at most KNOWN of them), and totals of SUFFIXES classes. The rest,
rare words, is met by a join on the hash, where no key can be hot because each is rare.

Model. A word with at least one training token in HEAVY (and 20 in all) is a class of its own, so is the end of a text; all
others share classes by their last three bytes. A state emits a class, a class emits its word with the probability
(c + 0.1) / (C + 0.1 (V + 1)) of its C tokens and V words, which leaves 0.1 for an unknown word. States begin as groups of
frequent words that appear in the same stretches of text; then `rounds` Baum-Welch rounds run over all training texts, each as
a whole: stretches of SPAN tokens are worked side by side, and messages by their transfer matrices carry what comes before
and after over the borders. Each partition adds up its expected counts, one shuffle sums them by class. The classes of
the training texts stay the same in all rounds, so they are written once, two bytes a token (four for large models).

Scoring. The likelihood of a whole text is exact for any length: stretches are turned into transfer matrices all at once, and
a scaled forward recursion runs over the stretches.

A null or empty text is the end token only. Rows are scored one by one, repeated or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import _binary, _run_of
from barloom.llm.words import Lookup, Words, mix, text_slices
from barloom.session import discard, written

STATES = 8
SPAN = 64
SUFFIXES = 4096
KNOWN, HEAVY, LEAST = 1 << 20, 1 << 16, 20
SEEDS = 256  # frequent words that set the first states
END = np.uint64(0x9E3779B97F4A7C15)
ADD = 0.1
TOKENS = 1 << 18  # classes worked at a time; a longer text is one slice


def _suffix(w: Words) -> np.ndarray:
    size = w.end - w.start
    byte = lambda k: np.where(size >= k, w.raw[np.maximum(w.end - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(byte(1) | byte(2) << np.uint64(16) | byte(3) << np.uint64(32)) >> np.uint64(52)).astype(np.int64)


def _with_end(w: Words, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values a word with `end` after each text, and where each text begins."""
    starts = w.offsets + np.arange(len(w.offsets))
    out = np.full(len(values) + w.n_texts, end, dtype=values.dtype)
    out[np.arange(len(values)) + w.text] = values
    return out, starts


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(h, b, n): tokens of each word and of the end (b = -1), with the word's suffix class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ends = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, first, inv = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            return h, np.concatenate([x[1] for x in held])[first], np.bincount(inv, np.concatenate([x[2] for x in held])).astype(np.int64)

        def out(h, b, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(b.astype(np.int32)), pa.array(n)], ["h", "b", "n"])

        for batch in batches:
            for _, _, raw, bounds in text_slices(batch.column(0)):
                w = Words(raw, bounds)
                ends += w.n_texts
                h, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((h, _suffix(w)[first], n))
                if sum(len(x[0]) for x in held) > 1 << 20:
                    held = [merged()]
                    if len(held[0][0]) > 1 << 19:
                        yield out(*held[0])
                        held = []
        if held:
            yield out(*merged())
        if ends:
            yield out(np.array([END]), np.array([-1]), np.array([ends]))

    return texts.select(column).mapInArrow(run, "h bigint, b int, n bigint").groupBy("h", "b").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Bounded parts: at most KNOWN words and HEAVY + SUFFIXES classes."""

    tokens: int
    words: int
    heavy: int
    lookup: Lookup
    cls: np.ndarray  # class of each known word
    logc: np.ndarray  # log10(c + ADD) of each known word
    size: np.ndarray  # C + ADD (V + 1) of each suffix class
    base: np.ndarray  # probability of each class
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes by states
    likelihoods: list[float] = field(default_factory=list)  # natural-log likelihood of the training texts before each round

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and its place among the known words (-1: rare or unknown)."""
        at = self.lookup(w.hash)
        return np.where(at >= 0, self.cls[at] if len(self.cls) else 0, self.heavy + _suffix(w)), at

    @property
    def kind(self) -> str:
        """The number that holds a class in a table."""
        return "<u2" if self.heavy + SUFFIXES <= 1 << 16 else "<u4"


def _empty_model(counts: DataFrame) -> Model:
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, words = int(total[0] or 0), int(total[1])
    known = counts.filter(F.col("n") * KNOWN >= tokens).toPandas()  # at most KNOWN rows
    known = known.sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
    end = known["b"] == -1
    top = ((known["n"] * HEAVY >= tokens) & (known["n"] >= LEAST)) | end
    heavy = int((top & ~end).sum()) + 1
    cls = np.where(end, 0, np.where(top, np.cumsum(top & ~end), heavy + known["b"])).astype(np.int64)
    rare = (F.col("b") >= 0) & ~((F.col("n") * HEAVY >= tokens) & (F.col("n") >= LEAST))
    shared = counts.filter(rare).groupBy("b").agg(F.sum("n").alias("c"), F.count("*").alias("v")).toPandas()  # one row a suffix class
    size = np.full(SUFFIXES, ADD)
    size[shared["b"]] = shared["c"] + ADD * (shared["v"] + 1)
    mass = np.zeros(heavy)
    mass[cls[top]] = known["n"][top]
    mass[0] = max(mass[0], 1)
    base = np.concatenate([mass, size])
    base /= base.sum()
    return Model(tokens, words, heavy, Lookup(known["h"].to_numpy().astype(np.int64).view(np.uint64)), cls, np.log10(known["n"].to_numpy(dtype=float) + ADD), size, base, None, None, None)


def _stretches(cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of at most SPAN tokens, longest first: first token, length, text, place in the text."""
    size = np.diff(starts)
    n = -(-size // SPAN)
    text = np.repeat(np.arange(len(size)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = starts[text] + place * SPAN
    length = np.minimum(SPAN, starts[text + 1] - first)
    order = np.argsort(-length, kind="stable")
    return first[order], length[order], text[order], place[order]


def _classes(shared):
    """The classes of each text and its end, as a run of `Model.kind`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        size = np.dtype(m.kind).itemsize
        for b in batches:
            for _, _, raw, bounds in text_slices(b.column(0), 1 << 20):
                w = Words(raw, bounds)
                cls, starts = _with_end(w, m.encode(w)[0], 0)
                yield pa.RecordBatch.from_arrays([_binary(cls.astype(m.kind).view(np.uint8), size * starts)], ["classes"])

    return run


def _class_slices(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of about TOKENS tokens at a time, and where each text begins in them."""
    for b in batches:
        raw, starts = _run_of(b.column(0))
        cls, starts = raw.view(kind), starts // np.dtype(kind).itemsize
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + TOKENS, side="right")) - 1)
            yield cls[starts[at] : starts[to]].astype(np.int64), starts[at : to + 1] - starts[at]
            at = to


def _cooccurrence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        both = np.zeros((SEEDS, SEEDS), dtype=np.int64)
        for cls, starts in _class_slices(batches, m.kind):
            keep = np.flatnonzero((cls >= 1) & (cls <= SEEDS) & (cls < m.heavy))
            text = np.searchsorted(starts, keep, side="right") - 1
            _, row = np.unique(text * (1 << 32) + (keep - starts[text]) // SPAN, return_inverse=True)
            x = np.zeros((int(row.max(initial=-1)) + 1, SEEDS), dtype=np.float32)
            x[row, cls[keep] - 1] = 1
            both += (x.T @ x).astype(np.int64)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j])], ["i", "j", "n"])

    return run


def _first_states(m: Model, both: np.ndarray, states: int) -> None:
    """Group the seed words by what they appear with; each state favours one group."""
    n = np.maximum(np.diag(both), 1)
    near = np.maximum(0, np.log((both + 0.1) * max(n.sum(), 1) / (np.outer(n, n) * 8.0)))
    np.fill_diagonal(near, 0)
    values, vectors = np.linalg.eigh(near)
    spots = vectors[:, -states:] * np.sqrt(np.abs(values[-states:]))
    spots /= np.maximum(np.linalg.norm(spots, axis=1, keepdims=True), 1e-9)
    used = np.flatnonzero(np.diag(both) > 0)
    group = np.full(SEEDS, -1)
    if len(used):
        centers = [spots[used[0]]]
        while len(centers) < states:
            far = np.max(spots[used] @ np.array(centers).T, axis=1)
            centers.append(spots[used[np.argmin(far)]])
        c = np.array(centers)
        for _ in range(20):
            group[used] = np.argmax(spots[used] @ c.T, axis=1)
            for k in range(states):
                if (group == k).any():
                    c[k] = spots[group == k].mean(0)
                    c[k] /= max(np.linalg.norm(c[k]), 1e-9)
    emit = np.repeat(m.base[:, None], states, axis=1)
    for i in np.flatnonzero(group >= 0):
        if 1 + i < m.heavy:
            emit[1 + i] *= np.where(np.arange(states) == group[i], 1.0, 0.1)
    m.emit = emit / emit.sum(0)
    m.start = np.full(states, 1 / states)
    m.move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))


def _by_place(place: np.ndarray) -> list[np.ndarray]:
    """Rows of each place in turn."""
    order = np.argsort(place, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []


def _messages(m: Model, cls: np.ndarray, stretches: tuple[np.ndarray, ...], emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each stretch hears from its text: the states before its first token, given all tokens before it, and the weight
    of the states of its last token by all tokens after it. Transfer matrices of the stretches carry both over the borders."""
    first, length, text, place = stretches
    k = emit.shape[1]
    move = m.move.astype(np.float32)
    before, after = np.zeros((len(first), k), dtype=np.float32), np.ones((len(first), k), dtype=np.float32)
    rest = np.flatnonzero(place > 0)
    if not len(rest):
        return before, after
    at = np.empty(len(first), dtype=np.int64)  # the stretch of each text and place
    base = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
    at[base[text] + place] = np.arange(len(first))
    ahead = at[base[text[rest]] + place[rest] - 1]  # the stretch before each that is not a text's first
    matrix = np.repeat(np.eye(k, dtype=np.float32)[None], len(rest), axis=0)
    live = np.searchsorted(-length[rest], -np.arange(1, length[rest][0] + 1), side="right")
    # only the directions of a matrix count: emissions are taken against their largest, and sizes mended now and then
    relative = emit / emit.max(1, keepdims=True)
    token = first[rest]
    for t, n in enumerate(live):
        part = (matrix[:n].reshape(-1, k) @ move).reshape(n, k, k)
        part *= relative[cls[token[:n] + t]][:, None, :]
        if t % 8 == 7:
            part /= part.max((1, 2), keepdims=True)
        matrix[:n] = part
    heads = np.unique(ahead[place[rest] == 1])
    last = np.repeat(m.start.astype(np.float32)[None], len(heads), axis=0)
    for t in range(SPAN):  # a stretch with one after it is full
        last = (last @ move if t else last) * emit[cls[first[heads] + t]]
        last /= last.sum(1, keepdims=True)
    end = np.zeros((len(first), k), dtype=np.float32)
    end[heads] = last
    rows = _by_place(place[rest])
    for r in rows:
        before[rest[r]] = end[ahead[r]]
        v = np.einsum("nk,nkj->nj", before[rest[r]], matrix[r])
        end[rest[r]] = v / v.sum(1, keepdims=True)
    for r in reversed(rows):
        v = np.einsum("nkj,nj->nk", matrix[r], after[rest[r]])
        after[ahead[r]] = v / v.sum(1, keepdims=True)
    return before, after


def _expected(m: Model, cls: np.ndarray, starts: np.ndarray, emit: np.ndarray, counts: np.ndarray, moves: np.ndarray, first_: np.ndarray) -> float:
    """Add the expected counts of whole texts, and give their natural-log likelihood: forward and backward over all
    stretches at once, longest first, each from what it hears over its borders."""
    stretches = first, length, _, place = _stretches(cls, starts)
    if not len(first):
        return 0.0
    k = emit.shape[1]
    move, start = m.move.astype(np.float32), m.start.astype(np.float32)
    before, after = _messages(m, cls, stretches, emit)
    inner = place > 0
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    fwd, seen, scale, log = [], [], [], 0.0
    for t in range(length[0]):
        n = live[t]
        e = emit[cls[first[:n] + t]]
        a = (fwd[-1][:n] @ move if t else np.where(inner[:, None], before @ move, start)) * e
        s = a.sum(1, keepdims=True)
        log += float(np.log(s, dtype=np.float64).sum())
        fwd.append(a / s), seen.append(e), scale.append(s)
    beta = np.ones((0, k), dtype=np.float32)
    gammas, tokens = [], []
    for t in range(length[0] - 1, -1, -1):
        n = live[t]
        grown = after[:n].copy()  # of the stretches that end here; the rest is filled in
        ends = fwd[t][len(beta) : n] * grown[len(beta) :]
        grown[len(beta) :] /= ends.sum(1, keepdims=True)
        if t + 1 < length[0]:
            n1 = live[t + 1]
            ahead = seen[t + 1] * beta / scale[t + 1]
            moves += (fwd[t][:n1].T @ ahead) * move
            grown[:n1] = ahead @ move.T
        beta = grown
        gammas.append(fwd[t] * beta), tokens.append(cls[first[:n] + t])
    if inner.any():  # the moves over borders
        moves += (before[inner].T @ (seen[0] * beta / scale[0])[inner]) * move
    first_ += gammas[-1][~inner].sum(0)
    gamma, token = np.concatenate(gammas), np.concatenate(tokens)
    for i in range(k):
        counts[:, i] += np.bincount(token, gamma[:, i], minlength=len(counts))
    return log


def _expectation(shared):
    """Expected counts of a partition, one row a class that occurs; moves, starts and the log likelihood follow under
    negative numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = m.emit.shape[1]
        emit = m.emit.astype(np.float32)
        counts, moves, first, log = np.zeros(m.emit.shape), np.zeros((k, k)), np.zeros(k), 0.0
        for cls, starts in _class_slices(batches, m.kind):
            log += _expected(m, cls, starts, emit, counts, moves, first)
        used = np.flatnonzero(counts.sum(1))
        keys = np.concatenate([used, -1 - np.arange(k + 2)])
        rows = np.concatenate([counts[used], moves, first[None], np.full((1, k), log / k)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(rows[:, i]) for i in range(k))], ["c", *(f"s{i}" for i in range(k))])

    return run


def train(texts: DataFrame, column: str, counts: DataFrame, states: int = STATES, rounds: int = 4) -> Model:
    """The model of `counts` fitted to all `texts`."""
    sc = texts.sparkSession.sparkContext
    m = _empty_model(counts)
    shared = sc.broadcast(m)
    classes = written(texts.select(column).mapInArrow(_classes(shared), "classes binary"))
    pairs = classes.mapInArrow(_cooccurrence(shared), "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((SEEDS, SEEDS))
    both[pairs["i"], pairs["j"]] = pairs["n"]
    _first_states(m, both, states)
    names = [f"s{i}" for i in range(states)]
    for _ in range(rounds):
        shared = sc.broadcast(m)
        rows = classes.mapInArrow(_expectation(shared), "c bigint, " + ", ".join(f"{n} double" for n in names))
        sums = rows.groupBy("c").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # one row a class
        shared.unpersist()
        key, value = sums["c"].to_numpy(), sums[names].to_numpy()
        seen = np.zeros((len(m.base), states))
        seen[key[key >= 0]] = value[key >= 0]
        extra = np.zeros((states + 2, states))
        extra[-1 - key[key < 0]] = value[key < 0]
        m.likelihoods.append(float(extra[-1].sum()))
        total = seen.sum(0)
        weight = 50 + 0.005 * total
        m.emit = (seen + weight * m.base[:, None]) / (total + weight)
        m.move = (extra[:states] + 1 / states) / (extra[:states].sum(1, keepdims=True) + 1)
        m.start = (extra[states] + 1 / states) / (extra[states].sum() + 1)
    discard(classes)
    return m


def _likelihood(m: Model, cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Natural-log likelihood of each text's classes: transfer matrices of stretches, then a forward pass over them."""
    first, length, text, place = _stretches(cls, starts)
    k, n_texts = len(m.start), len(starts) - 1
    out = np.zeros(n_texts)
    if not len(first):
        return out
    emit, move = m.emit, m.move
    heads, rest = np.flatnonzero(place == 0), np.flatnonzero(place > 0)

    def scaled(rows: np.ndarray, begin: np.ndarray, width: int, step_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Run `width` forward vectors a stretch; gives them and the logarithm taken out."""
        state, log = begin, np.zeros(len(rows))
        if not len(rows):
            return state, log
        live = np.searchsorted(-length[rows], -np.arange(1, length[rows][0] + 1), side="right")
        for t in range(len(live)):
            n = live[t]
            part = state[:n]
            if t or step_first:
                part = (part.reshape(-1, k) @ move).reshape(n, width, k)
            part = part * emit[cls[first[rows[:n]] + t]][:, None, :]
            if t % 8 == 7:  # eight emissions stay far above the least number
                s = part.sum((1, 2))
                part /= s[:, None, None]
                log[:n] += np.log(s)
            state[:n] = part
        s = state.sum((1, 2))
        return state / s[:, None, None], log + np.log(s)

    vector, log = scaled(heads, np.repeat(m.start[None, None], len(heads), axis=0), 1, False)
    alpha = np.zeros((n_texts, k))
    alpha[text[heads]], out[text[heads]] = vector[:, 0], log
    matrix, mlog = scaled(rest, np.repeat(np.eye(k)[None], len(rest), axis=0), k, True)
    order = np.argsort(place[rest], kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(place[rest][order]) != 0)) if len(rest) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        r = order[a:b]
        t = text[rest[r]]
        v = np.einsum("nk,nkj->nj", alpha[t], matrix[r])
        s = v.sum(1)
        alpha[t] = v / s[:, None]
        out[t] += np.log(s) + mlog[r]
    return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        den = np.log10(m.size)
        end = m.lookup(np.array([END]))[0]
        for b in batches:
            for at, to, raw, bounds in text_slices(b.column("_t"), 2 << 20):
                w = Words(raw, bounds)
                own, known = m.encode(w)
                cls, starts = _with_end(w, own, 0)
                forward = _likelihood(m, cls, starts) / np.log(10)
                n = w.n_texts
                add = lambda where, v: np.bincount(w.text[where], v, minlength=n)
                has = known >= 0
                lc = m.logc[known[has]] if has.any() else np.zeros(0)
                base = add(has, lc) + (m.logc[end] if end >= 0 else np.log10(ADD))
                shared_ = own >= m.heavy
                inside = add(has & shared_, m.logc[known[has & shared_]] if len(m.logc) else None) if (has & shared_).any() else np.zeros(n)
                inside -= add(shared_, den[own[shared_] - m.heavy])
                n_known = np.bincount(w.text[has], minlength=n) + (end >= 0)
                rare = ~has
                order = np.lexsort((w.hash[rare], w.text[rare]))
                h, t = w.hash[rare][order], w.text[rare][order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.zeros(0, np.int64)
                cut = np.searchsorted(t[new], np.arange(n + 1)).astype(np.int32)
                size = np.diff(np.append(new, len(h)))
                lists = lambda v: pa.ListArray.from_arrays(pa.array(cut), pa.array(v))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").slice(at, to - at), pa.array(np.diff(starts)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(forward + inside), lists(h[new].view(np.int64)), lists(size.astype(np.int32))],
                    ["doc", "n_tokens", "n_known", "base", "model", "rare", "times"],
                )

    return run


def score(docs: DataFrame, m: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """Every row as `doc` with n_tokens, n_known, base_score and score (log10)."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), F.col(text).alias("_t"))
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, n_tokens bigint, n_known bigint, base double, model double, rare array<bigint>, times array<int>"
    parts = written(rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(m)), schema).withColumn("row", F.monotonically_increasing_id()))
    met = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("k"))
    rare = counts.filter(F.col("n") * KNOWN < m.tokens).select("h", "n")
    joined = met.join(rare, "h", "left")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("_known"), F.sum(F.col("k") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + ADD)).alias("_log"))
    out = parts.drop("rare", "times").join(sums, "row", "left")
    log = F.coalesce("_log", F.lit(0.0))
    return out.select(
        "doc", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(float(np.log10(m.tokens + ADD * (m.words + 1))))).alias("base_score"), (F.col("model") + log).alias("score"),
    )


def score_all(docs: DataFrame, training: Column, text: str = "text", states: int = STATES, rounds: int = 4) -> tuple[DataFrame, Model]:
    """Learn from the rows where `training` holds and score every row."""
    texts = docs.filter(training).select(text)
    counts = written(word_counts(texts, text))
    m = train(texts, text, counts, states, rounds)
    return score(docs, m, counts, text), m
