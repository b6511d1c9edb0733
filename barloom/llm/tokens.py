"""Token ids in a compact binary table, and back.

Format, version 1. `encode` writes two Parquet tables below one folder:

* `blocks`: one row a document, in ascending order of its id over all files: part (the file's number, from 0 in order),
  pos (place in the file), doc_id, n_tokens, control, data. Ids stand as ranks by frequency (0 is the most frequent;
  ties by id). A rank takes one to four bytes, little-endian, in `data`; `control` holds the number of bytes less one in
  two bits, four ranks a byte, the first in the lowest bits. Trailing bits are zero.
* `ranks`: (rank, id, n), one row an id that occurs; at most one a vocabulary entry, so it travels by broadcast.

Parquet's codec for blocks is zstd, as it is for the ids in between, which are removed once the blocks are there: bytes of ranks and
ids repeat too little for snappy.

The tokenizer drops white space and never looks across it, so a text's ids are those of its words in order, and of the
runs of letters and of signs in a word; a process keeps the ids of those it has met, up to CACHE, by 64-bit hash, length and sum
of bytes. Documents of equal id are ordered by a hash of their text; null ids
come first. A null or empty text has the end id only.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.words import _IS_SPACE, _LOWER, Lookup, Words, released, text_slices
from barloom.session import discard, shared_folder, written

CACHE = 1 << 19
BATCH = 20_000
SLICE = 1 << 20
TOKENS = 1 << 19
_CACHED: dict[tuple[str, int], _Encoder] = {}
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class _Known:
    """Ids of the pieces met so far, in one run, by their hash. What there is no room for is held until the next is added."""

    def __init__(self, end_id: int, kind: str):
        self.rows, self.mark = Lookup(np.zeros(0, np.uint64), CACHE), np.zeros(1 << 12, dtype=np.uint64)
        self.ids, self.upto = np.zeros(1 << 14, dtype=kind), np.zeros(1 << 12, dtype=np.int64)
        self.ids[0], self.upto[1] = end_id, 1  # before the first row

    def find(self, h: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each piece, and which ones have none or that of another piece."""
        row = self.rows(h)
        return row, (row < 0) | (self.mark[row] != mark)

    def add(self, h: np.ndarray, mark: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: bool) -> np.ndarray:
        """The rows of new pieces."""
        n, to = self.rows.n, self.rows.n + len(h)
        begin = self.upto[n + 1]
        self.mark, self.upto, self.ids = _long(self.mark, to), _long(self.upto, to + 2), _long(self.ids, begin + len(ids))
        self.mark[n:to], self.ids[begin : begin + len(ids)] = mark, ids
        self.upto[n + 2 : to + 2] = begin + np.cumsum(size)
        if keep:
            self.rows.add(h[: len(self.rows.keys) - n])
        return np.arange(n, to)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows (-1: the end id) in one run, and where each row begins in it."""
        width = self.ids.itemsize
        upto = pa.py_buffer(self.upto * width)
        all_rows = pa.Array.from_buffers(pa.large_binary(), len(self.upto) - 1, [None, upto, pa.py_buffer(self.ids)])
        _, starts, data = all_rows.take(pa.array(rows + 1)).buffers()
        starts = np.frombuffer(starts, dtype=np.int64)[: len(rows) + 1] // width
        return np.frombuffer(data, dtype=self.ids.dtype)[: starts[-1]], starts


def _long(values: np.ndarray, n: int) -> np.ndarray:
    """The values with place for n at least."""
    return values if len(values) >= n else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), dtype=values.dtype)])


@dataclass
class _Encoder:
    tok: object
    ends: np.ndarray  # ids that end a piece
    whole: np.ndarray  # bytes of words that must stay whole, unless they belong to a letter
    cuts: bool  # letters and signs next to each other are pieces of their own
    folds: bool  # capitals A-Z count as small letters
    known: _Known


def _encoder(model: str, end_id: int) -> _Encoder:
    """The tokenizer (its definition travels with the task), what holds for its pieces, and this process's pieces."""
    if (model, end_id) not in _CACHED:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_str(model)
        vocabulary = tok.get_vocab()
        suffix = getattr(tok.model, "end_of_word_suffix", None)
        last = max(vocabulary.values())
        ends = np.zeros(last + 1, dtype=bool)
        if suffix:
            ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        whole = np.zeros(256, dtype=bool)
        # control signs inside words, the apostrophe of contractions, what special tokens begin with, and all beyond ASCII
        whole[[*range(32), *range(127, 256), ord("'"), *(t.content.encode()[0] for t in tok.get_added_tokens_decoder().values())]] = True
        whole &= ~_IS_SPACE
        ask = lambda t: [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(t)] if tok.pre_tokenizer else [t]
        cuts = bool(suffix) and not whole[ord("a")] and len(ask("ab,cd.-ef")) == 5 and len(ask("abé")) == 1
        normal = tok.normalizer.normalize_str if tok.normalizer else str
        folds = all(normal(chr(c)) == chr(c + 32) for c in range(65, 91))
        _CACHED.clear()
        _CACHED[model, end_id] = _Encoder(tok, ends, whole, cuts, folds, _Known(end_id, "<u2" if max(last, end_id) < 1 << 16 else "<u4"))
    return _CACHED[model, end_id]


def _encoded(words: list[bytes], plain: np.ndarray, e: _Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pieces, their ids in that order, and each one's number of ids. Plain ones, of letters only, are encoded side
    by side in one text and parted by the ids that end a piece; the rest are encoded one by one."""
    order, ids, size, rest = [], [], [], [np.flatnonzero(~plain)]
    some = np.flatnonzero(plain)
    for at in range(0, len(some), BATCH):
        part = some[at : at + BATCH]
        text = b" ".join([words[i] for i in part]).decode()
        found = np.array(e.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=e.known.ids.dtype)
        cut = np.flatnonzero(e.ends[found]) + 1
        if len(cut) != len(part):
            rest.append(part)
            continue
        order, ids, size = [*order, part], [*ids, found], [*size, np.diff(cut, prepend=0)]
    rest = np.concatenate(rest)
    for at in range(0, len(rest), BATCH):
        part = rest[at : at + BATCH]
        found = [x.ids for x in e.tok.encode_batch_fast([words[i].decode() for i in part], add_special_tokens=False)]
        order, ids, size = [*order, part], [*ids, np.array([i for x in found for i in x], dtype=e.known.ids.dtype)], [*size, np.array(list(map(len, found)))]
    return np.concatenate(order), np.concatenate(ids), np.concatenate(size)


def _pieces(raw: np.ndarray, bounds: np.ndarray, e: _Encoder) -> tuple[Words, np.ndarray]:
    """Words, cut between letters and signs where that is safe, and which pieces are letters only.

    Letters are those of ASCII and of U+00C0 to U+00FF. A word with any other byte beyond ASCII, or one of `whole`, stays
    in one piece as it is.
    """
    w = Words(raw, bounds, lower=False)
    if not e.cuts or not len(w.start):
        return w, np.zeros(len(w.start), dtype=bool)
    letter, odd = _LETTER[raw], e.whole[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    tail = raw[lead + 1]
    lead = lead[(tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)]
    for at in (lead, lead + 1):
        letter[at], odd[at] = True, False
    odd = np.flatnonzero(odd)
    of = np.searchsorted(w.start, odd, side="right") - 1
    cut = np.ones(len(w.start), dtype=bool)
    cut[of[(of >= 0) & (odd < w.end[of])]] = False
    inside = w.within(cut)
    starts = np.zeros(len(raw), dtype=bool)
    starts[1:] = (letter[1:] != letter[:-1]) & inside[1:] & inside[:-1]
    if e.folds:
        raw = np.where(inside, _LOWER[raw], raw)
    out = w.cut(raw, starts)
    return out, letter[out.start] & inside[out.start]


def _distinct(h: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct piece, and which of them every piece is. Should two of one hash differ, each counts as
    distinct."""
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    return (first, of) if (mark == mark[first][of]).all() else (np.arange(len(mark)), np.arange(len(mark)))


def _rows(w: Words, plain: np.ndarray, e: _Encoder) -> np.ndarray:
    """The row of each piece among the known ones; new ones are encoded. Pieces of one hash are held against each other by length
    and sum of bytes too; where two differ, this call's new pieces are not kept."""
    total = np.concatenate([np.zeros(1, np.uint32), np.cumsum(w.raw, dtype=np.uint32)])
    mark = (w.end - w.start).astype(np.uint64) << np.uint64(32) | (total[w.end] - total[w.start])
    row, new = e.known.find(w.hash, mark)
    new = np.flatnonzero(new)
    if len(new):
        first, of = _distinct(w.hash[new], mark[new])
        at, data = new[first], w.raw.tobytes()
        order, ids, size = _encoded([data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())], plain[at], e)
        h = w.hash[at[order]]
        found = np.empty(len(at), dtype=row.dtype)
        found[order] = e.known.add(h, mark[at[order]], ids, size, keep=(row[at] < 0).all() and len(np.unique(h)) == len(h))
        row[new] = found[of]
    return row


def ids_of_slice(raw: np.ndarray, bounds: np.ndarray, model: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a slice, each with the end id, in one array, and where each text begins in it."""
    e = _encoder(model, end_id)
    w, plain = _pieces(raw, bounds, e)
    rows = np.full(len(w.start) + w.n_texts, -1, dtype=np.int32)
    rows[np.arange(len(w.start)) + w.text] = _rows(w, plain, e)
    ids, starts = e.known.gather(rows)
    return ids, starts[w.offsets + np.arange(len(w.offsets))]


def ids_of(texts: list[str | None], model: str, end_id: int) -> list[bytes]:
    """The ids of each text and the end id, as little-endian 32-bit numbers."""
    out = []
    for _, _, raw, bounds in text_slices(pa.array(texts, pa.large_string()), SLICE):
        ids, starts = ids_of_slice(raw, bounds, model, end_id)
        out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, starts[1:])]
    return out


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column from one run of bytes and where each value begins."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _run_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins in them."""
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def _token_slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about TOKENS ids at a time; a longer document is one slice."""
    upto = np.concatenate([[0], np.cumsum(b.column("n_tokens").to_numpy())])
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + TOKENS, side="right")) - 1)
        yield b.slice(at, to - at)
        at = to


def _ids_in(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch of the first table, and where each document begins in them."""
    raw, starts = _run_of(b.column("ids"))
    width = b.column("width").to_numpy()
    if (width == 2).all():
        return raw.view("<u2"), starts // 2
    parts = [raw[a:e].view("<u2" if w == 2 else "<u4").astype(np.uint32) for a, e, w in zip(starts, starts[1:], width)]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def pack_all(ranks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of runs of ranks, each with where every run begins."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    upto = np.concatenate([[0], np.cumsum(size)])
    n = np.diff(starts)
    at = np.concatenate([[0], np.cumsum(-(-n // 4))])
    codes = np.zeros(4 * at[-1], dtype=np.uint8)
    codes[np.arange(len(ranks)) + np.repeat(4 * at[:-1] - starts[:-1], n)] = size - 1
    codes = codes.reshape(-1, 4)
    return codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6, at, data, upto[starts]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of one run of ranks."""
    control, _, data, _ = pack_all(ranks, np.array([0, len(ranks)]))
    return control.tobytes(), data.tobytes()


#: Bytes of each of the four ranks under a control byte, by rule.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def unpack_all(control: np.ndarray, at: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranks of runs: sizes from the table of control bytes, then one gather of four bytes a rank."""
    size = _SIZES[control].ravel()
    if len(size) != n.sum():  # the last control byte of a run may be part empty
        upto = np.cumsum(n)
        size = size[np.arange(upto[-1]) + np.repeat(4 * at[:-1] - (upto - n), n)]
    begin = np.cumsum(size) - size
    raw = np.concatenate([data, np.zeros(3, np.uint8)])
    out = raw[begin].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        out |= np.where(size > k, raw[begin + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks of one run."""
    return unpack_all(np.frombuffer(control, np.uint8), np.array([0, len(control)]), np.frombuffer(data, np.uint8), np.array([n]))


def _ids_table(docs: DataFrame, text: str, doc_id: str, model: str, end_id: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, raw, bounds in text_slices(b.column("t"), SLICE):
                ids, starts = ids_of_slice(raw, bounds, model, end_id)
                width = ids.itemsize
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(np.diff(starts)), pa.array(np.full(to - at, width, dtype=np.int32)), _binary(ids.view(np.uint8), width * starts)],
                    ["doc_id", "h", "n_tokens", "width", "ids"],
                )

    return rows.mapInArrow(released(run), f"doc_id {kind}, h bigint, n_tokens bigint, width int, ids binary")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for b in (x for whole in batches for x in _token_slices(whole)):
        n = np.bincount(_ids_in(b)[0])
        if len(n) > len(total):
            total = np.concatenate([total, np.zeros(len(n) - len(total), dtype=np.int64)])
        total[: len(n)] += n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


def encode(docs: DataFrame, model_path: str, folder: str | None = None, text: str = "text", doc_id: str = "doc_id", end_id: int = 1, files: int | None = None) -> str:
    """Write the format above and give its folder (a new one in the shared folder by default)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/barloom-tokens/{uuid.uuid4().hex}"
    with open(model_path, encoding="utf-8") as f:  # on the driver; the definition travels with the tasks
        model = f.read()
    ids = written(_ids_table(docs, text, doc_id, model, end_id), "zstd")
    counts = ids.select("n_tokens", "width", "ids").mapInArrow(released(_count), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])  # at most one row a vocabulary entry
    spark.createDataFrame(counts.assign(rank=np.arange(len(counts)))[["rank", "id", "n"]], "rank bigint, id bigint, n bigint").coalesce(1).write.parquet(f"{folder}/ranks")
    table = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, dtype=np.uint32)
    table[counts["id"]] = np.arange(len(counts))
    ranks = spark.sparkContext.broadcast(table)
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in _token_slices(whole)):
            found, starts = _ids_in(b)
            control, at, data, upto = pack_all(ranks.value[found], starts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), b.column("n_tokens"), _binary(control, at), _binary(data, upto)],
                ["doc_id", "h", "n_tokens", "control", "data"],
            )

    coded = ids.mapInArrow(released(run), f"doc_id {kind}, h bigint, n_tokens bigint, control binary, data binary")
    n = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = coded.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    numbered = ordered.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    numbered.select("part", "pos", "doc_id", "n_tokens", "control", "data").write.parquet(f"{folder}/blocks", compression="zstd")
    discard(ids)
    return folder


def decoded(spark: SparkSession, folder: str, of, schema: str) -> DataFrame:
    """(part, pos, doc_id, n_tokens, value): `of(ids)` of every document's ids, read from the files."""
    ranks = spark.read.parquet(f"{folder}/ranks").toPandas()  # at most one row a vocabulary entry
    table = np.zeros(len(ranks), dtype=np.uint32)
    table[ranks["rank"]] = ranks["id"]
    ids = spark.sparkContext.broadcast(table)
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "pos", "doc_id", "n_tokens", "control", "data")
    kind = blocks.schema["doc_id"].dataType.simpleString()
    arrow = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in _token_slices(whole)):
            control, at = _run_of(b.column("control"))
            n = b.column("n_tokens").to_numpy()
            found = ids.value[unpack_all(control, at, _run_of(b.column("data"))[0], n)]
            end = np.cumsum(n)
            values = [of(found[a:e]) for a, e in zip(end - n, end)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "pos", "doc_id", "n_tokens")), pa.array(values, arrow)], ["part", "pos", "doc_id", "n_tokens", "value"])

    return blocks.mapInArrow(released(run), f"part int, pos bigint, doc_id {kind}, n_tokens bigint, value {schema}")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    rows = decoded(spark, folder, crc, "long")
    sums = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_first"))  # one row a file
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos")) - F.col("n_tokens")
    return rows.withColumn("_at", within).join(F.broadcast(starts), "part").select("doc_id", (F.col("_first") + F.col("_at")).alias("start"), "n_tokens", F.col("value").alias("ids_crc32"))
