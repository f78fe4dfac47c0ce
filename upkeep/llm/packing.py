"""Packing by lexical retrieval: documents into sequences of a fixed token length.

1. Every whole text is encoded (``unit_ids``, an end id added) and written with
   its signature, the least hash of its terms. Terms are the words as the
   vocabulary spells them: runs of tokens of letters, digits and non-ASCII bytes.
2. The table is dealt by ranges of (signature, row), so texts with a common
   vocabulary lie together and a hot signature spans many tasks. A task cuts its
   rows into index shards of about ``SHARD_TOKENS`` tokens. A shard has a BM25
   inverted index of what is left of each document after its full windows (those
   are sequences of their own). The next unused document seeds a window; the
   index returns its unused neighbours, best first, which greedily fill the
   window. The one that overflows is cut, and its rest seeds the next window.
   Documents of a shard's last, unfilled window go on to the next shard.
3. What is left in each task, less than a window, is put together for every
   ``TAILS`` tasks, laid end to end and cut; a remainder gives
   sequences of powers of two. So no sequence is padded.

Every id lies in exactly one piece, whatever the neighbours are. Nothing is
bounded by the corpus: a task holds one shard and one batch.

Defined cases: a null or empty text is its end id alone; rows that share an id
are documents of their own; a null id stays null; a document longer than a shard
is cut into windows first; ties in score go to the earlier row; a seed that
shares no term with an unused document takes the next unused in order; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.storage import check_columns, written
from upkeep.llm.unit_ids import encoded_blocks, run_positions, unit_ids
from upkeep.llm.words import span_hashes

WINDOW = 2048
SHARD_TOKENS = 1 << 21
TAILS = 512
CANDIDATES = 16
K1, B = 1.2, 0.75
DTYPE = "<u2"

ENCODED = "doc_id long, row long, signature long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, sequence long, offset long, tail binary"

_classes: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable bytes stand for
    themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = unit_ids(path, DTYPE).tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else b""
    return out


def token_classes(path: str, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id: whether it starts a word, whether it is part of one, and the
    hash of its bytes in lower case without white space."""
    if (path, end_id) not in _classes:
        raw = token_bytes(path)
        starts = np.array([t[:1].isspace() for t in raw])
        part = np.array([bool(t.strip()) and all(c >= 0x80 or chr(c).isalnum() for c in t.strip()) for t in raw])
        part[end_id] = False
        value = np.array([zlib.crc32(t.strip().lower()) for t in raw], np.uint64)
        _classes[path, end_id] = starts, part, value
    return _classes[path, end_id]


def terms(ids: np.ndarray, bounds: np.ndarray, classes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each word of the texts ``ids[bounds]``."""
    starts, part, value = classes
    inside = part[ids]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | starts[ids[1:]]
    edge = bounds[(bounds > 0) & (bounds < len(ids))]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(bounds, start, "right") - 1, span_hashes(value[ids], start, end)


class Index:
    """BM25 inverted index of a shard. Terms of one document only and terms of
    more than half of the documents, whose weight is 0, have no postings."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, docs: int):
        self.docs = docs
        length = np.bincount(doc, minlength=docs).astype(float)
        _, code = np.unique(term, return_inverse=True)
        key, tf = np.unique(code * docs + doc, return_counts=True)
        code, doc = key // docs, key % docs
        df = np.bincount(code) if len(code) else np.zeros(0, int)
        weight = np.maximum(0.0, np.log((docs - df + 0.5) / (df + 0.5)))
        keep = ((df > 1) & (weight > 0))[code] if len(code) else np.zeros(0, bool)
        code, self.doc, tf = code[keep], doc[keep], tf[keep]
        norm = K1 * (1 - B + B * length / max(length.mean(), 1.0)) if docs else length
        self.weight = weight[code] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.df = np.bincount(code, minlength=len(df))
        self.start = np.cumsum(self.df) - self.df
        forward = np.argsort(self.doc, kind="stable")
        self.code = code[forward]
        self.first = np.searchsorted(self.doc[forward], np.arange(docs + 1))

    def scores(self, query: int) -> np.ndarray:
        """Score of every document for the distinct terms of a document."""
        own = self.code[self.first[query]:self.first[query + 1]]
        at = run_positions(self.start[own], self.df[own])
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.docs)


def fill(index: Index, sizes: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, its ids before, length); the last may be
    short. Documents are shorter than a window."""
    used = sizes == 0
    rest: tuple[int, int] | None = None
    order = 0
    while True:
        while order < len(sizes) and used[order]:
            order += 1
        if rest is None and order == len(sizes):
            return
        seed, done = rest or (order, 0)
        used[seed] = True
        rest = None
        pieces = [(seed, done, int(sizes[seed]) - done)]
        space = window - pieces[0][2]
        near: list[int] = []
        scores = None
        while space:
            if not near:
                if scores is None:
                    scores = index.scores(seed)
                scores[used] = 0.0
                best = np.argpartition(-scores, CANDIDATES)[:CANDIDATES] if len(scores) > CANDIDATES else np.arange(len(scores))
                if len(scores) > CANDIDATES:  # all that tie with the last one count
                    best = np.flatnonzero(scores >= scores[best].min()) if scores[best].min() > 0 else best
                best = np.sort(best)
                best = best[np.argsort(-scores[best], kind="stable")]
                near = [int(d) for d in best if scores[d] > 0]
                if not near:
                    while order < len(sizes) and used[order]:
                        order += 1
                    if order == len(sizes):
                        break
                    near = [order]
            doc = near.pop(0)
            used[doc] = True
            length = min(space, int(sizes[doc]))
            pieces.append((doc, 0, length))
            space -= length
            if length < sizes[doc]:
                rest = doc, length
        yield pieces


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.binary() if n == "tail" else pa.int64()) for n, c in zip(names, columns, strict=True)})


class Packer:
    """Shards of one task: takes documents, gives rows of ``PIECES``."""

    def __init__(self, part: int, window: int, classes: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.part, self.window, self.classes = part, window, classes
        self.sequence = 0
        self.waiting: list[tuple[int | None, np.ndarray, int, int]] = []  # id, ids, its ids before, ids of the document
        self.tokens = 0
        self.rows: list[tuple] = []

    def _put(self, doc: tuple[int | None, np.ndarray, int, int], at: int, length: int, offset: int, tail: bool = False) -> None:
        key, ids, before, total = doc
        own = ids[at:at + length].astype("<u4").tobytes()
        self.rows.append((key, before + at, length, zlib.crc32(own), total, self.part, self.sequence, offset, own if tail else None))

    def add(self, key: int | None, ids: np.ndarray) -> None:
        full = len(ids) - len(ids) % self.window
        doc = key, ids, 0, len(ids)
        for at in range(0, full, self.window):
            self._put(doc, at, self.window, 0)
            self.sequence += 1
        if full < len(ids):
            self.waiting.append((key, ids[full:], full, len(ids)))
            self.tokens += len(ids) - full

    def pack(self) -> None:
        """Pack the waiting documents; those of an unfilled window go on waiting."""
        docs, self.waiting, self.tokens = self.waiting, [], 0
        if not docs:
            return
        sizes = np.array([len(d[1]) for d in docs])
        found, term = terms(np.concatenate([d[1] for d in docs]), np.concatenate([[0], np.cumsum(sizes)]), self.classes)
        for pieces in fill(Index(found, term, len(docs)), sizes, self.window):
            if sum(p[2] for p in pieces) < self.window:
                for d, at, length in pieces:
                    key, ids, before, total = docs[d]
                    self.waiting.append((key, ids[at:at + length], before + at, total))
                    self.tokens += length
                break
            offset = 0
            for d, at, length in pieces:
                self._put(docs[d], at, length, offset)
                offset += length
            self.sequence += 1

    def finish(self) -> None:
        self.pack()
        offset = 0
        for doc in self.waiting:
            self._put(doc, 0, len(doc[1]), offset, tail=True)
            offset += len(doc[1])

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return _batch(rows)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (its number in the table), signature and ids of each document."""
    check_columns(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = token_classes(tokenizer_path, end_id)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            for lo, hi, ids, bounds in encoded_blocks(batch.column(1), tokenizer_path, end_id, DTYPE):
                doc, term = terms(ids, bounds, classes)
                least = np.full(hi - lo, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, doc, term)
                raw = ids.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": keys[lo:hi], "row": pa.array(np.arange(row, row + hi - lo), pa.int64()),
                    "signature": pa.array(least.view(np.int64), pa.int64()),
                    "ids": pa.array([raw[2 * a:2 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})
                row += hi - lo

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, ENCODED)


def _powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def tail_windows(rows: list[dict], group: int, window: int) -> list[tuple]:
    """Sequences of the pieces that tasks left over, laid end to end."""
    total = sum(r["length"] for r in rows)
    lengths = [window] * (total // window) + _powers_of_two(total % window)
    out, sequence, filled = [], 0, 0
    for r in rows:
        at = 0
        while at < r["length"]:
            length = min(r["length"] - at, lengths[sequence] - filled)
            own = r["tail"][4 * at:4 * (at + length)]
            out.append((r["doc_id"], r["start"] + at, length, zlib.crc32(own), r["doc_tokens"], group, sequence, filled, None))
            at, filled = at + length, filled + length
            if filled == lengths[sequence]:
                sequence, filled = sequence + 1, 0
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, shard_tokens: int = SHARD_TOKENS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset."""
    coded = written(encode(docs, tokenizer_path, end_id, id_col, text_col), "packing-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), window, token_classes(tokenizer_path, end_id))
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(key, np.frombuffer(raw.as_buffer(), DTYPE))
                if packer.tokens >= shard_tokens:
                    packer.pack()
                if len(packer.rows) >= 10_000:
                    yield packer.taken()
        packer.finish()
        yield packer.taken()

    dealt = coded.repartitionByRange("signature", "row").sortWithinPartitions("signature", "row").select("doc_id", "ids")
    pieces = written(dealt.mapInArrow(run, PIECES), "packing-pieces")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.drop_columns("tails").to_pylist(), key=lambda r: (r["part"], r["offset"]))
        return pa.Table.from_batches([_batch(tail_windows(rows, key[0].as_py(), window))])

    tails = pieces.where("tail IS NOT NULL").withColumn("tails", F.expr(f"part div {TAILS}")).groupBy("tails").applyInArrow(join, PIECES)
    number = "shiftleft(part, 32) + sequence"
    body = pieces.where("tail IS NULL").withColumn("sequence_id", F.expr(number))
    rest = tails.withColumn("sequence_id", F.expr(f"shiftleft(1L, 62) + {number}"))
    return body.unionByName(rest).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
