"""Filter interaction audit: what each of five filters removes, in every order.

A document's failed filters are a mask of five bits. Under an order of the filters
it goes at the first step whose letter is in its mask. All orders that begin with
the same letters are neighbours in lexicographic order, so the orders under which
a mask goes at a given step are intervals of Lehmer ranks: one for each prefix of
other letters that ends in one of its own. The audit adds a mask's count at an
interval's start, takes it off at its end, and a prefix sum over the 120 ranks
gives what every step of every order removes.

Spark finds the masks in one pass over the texts, the repeats by aggregation, and
counts by (part, mask); only those counts, 32 a part, reach the difference
arrays. No join has a text or a source alone as its key: repeats are found by
(digest, id), so a text that a third of all rows share is spread by its ids.

Filters (words: maximal runs outside ASCII white space, case-sensitive):
A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals A-Z > 5 *
code points; D any of ``#$%&*|``; E the same text as a document of a smaller id.

Defined cases: a null text is empty; a null source is the empty string; a null
id is larger than none and smaller than none, so it never makes or is a repeat;
rows that share an id are documents of their own; a document is good (toxic) if
any label row of its id has quality (toxic) 1; empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.storage import check_columns, written
from upkeep.llm.unit_ids import blocks, byte_strings, text_buffers

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = b"#$%&*|"
BLOCK = 1 << 22
PARTS = 256

MASKS = "doc_id long, part string, mask int, digest binary"
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(SIGNS)] = True


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Masks of filters A to D of the texts of a block."""
    letter = ~_SPACE[data]
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = letter[inner]
    end[inner - 1] = letter[inner - 1]
    at = np.flatnonzero(start)
    rows = len(offsets) - 1
    words = _counts(start, offsets)
    # the words without their white space lie end to end: Arrow finds the distinct ones
    lengths = np.flatnonzero(end) + 1 - at
    coded = byte_strings(data[letter], np.concatenate([[0], np.cumsum(lengths)])).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(rows), words)
    distinct = np.bincount(np.unique(owner * max(1, len(coded.dictionary)) + code) // max(1, len(coded.dictionary)), minlength=rows)
    points = _counts((data & 0xC0) != 0x80, offsets)
    return ((words < LEAST_WORDS) * 1 + (100 * distinct < LEAST_DISTINCT * words) * 2
            + (100 * _counts(_CAPITAL[data], offsets) > MOST_CAPITALS * points) * 4 + (_counts(_SIGN[data], offsets) > 0) * 8)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, part, mask (filters A to D) and digest of the text, one row per document."""
    check_columns(docs, id_col, text_col, source_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            for lo, hi in blocks(offsets, BLOCK):
                own = data[offsets[lo]:offsets[hi]]
                bounds = offsets[lo:hi + 1] - offsets[lo]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0)[lo:hi], "part": batch.column(1)[lo:hi], "mask": pa.array(text_masks(own, bounds), pa.int32()),
                    "digest": pa.array([hashlib.sha256(own[a:b]).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{text_col}`").alias("text")).mapInArrow(run, MASKS)


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, mask (of all five filters), n, good and toxic: counts of documents."""
    check_columns(labels, "doc_id", "quality", "toxic")
    found = masks(docs, id_col, text_col, source_col).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    found = written(found, "audit-masks")
    first = (found.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
             .select("digest", "doc_id", F.lit(True).alias("first")))
    repeat = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), REPEAT).otherwise(0)
    judged = (found.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + repeat)
              .groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")))
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")))
    lost = [F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]
    return judged.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *lost)


def intervals(mask: int) -> Iterator[tuple[int, int, int]]:
    """(step, first rank, last rank + 1) of the orders that remove ``mask``: steps
    count from 0. A prefix with Lehmer digits d0, d1, ... starts at the sum of
    d_i * (remaining letters)!"""
    def walk(left: list[int], step: int, rank: int) -> Iterator[tuple[int, int, int]]:
        below = math.factorial(len(left) - 1)
        for digit, letter in enumerate(left):
            start = rank + digit * below
            if mask >> letter & 1:
                yield step, start, start + below
            else:
                yield from walk(left[:digit] + left[digit + 1:], step + 1, start)

    if mask:
        yield from walk(list(range(len(FILTERS))), 0, 0)


def difference_arrays() -> np.ndarray:
    """(masks, steps, ranks + 1): +1 where a mask's interval starts, -1 where it ends."""
    out = np.zeros((1 << len(FILTERS), len(FILTERS), len(ORDERS) + 1), np.int64)
    for mask in range(1 << len(FILTERS)):
        for step, lo, hi in intervals(mask):
            out[mask, step, lo] += 1
            out[mask, step, hi] -= 1
    return out


def totals(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The report's numbers, (parts, ranks, steps), from counts by (part, mask)."""
    ends = difference_arrays()

    def removed(n: np.ndarray) -> np.ndarray:
        return np.cumsum(np.tensordot(n, ends, 1), axis=2)[:, :, :-1].transpose(0, 2, 1)

    letter = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    has = np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS)) & 1
    gone = removed(counts)
    by_letter = np.stack([np.where(letter == f, gone, 0).sum(axis=(1, 2)) for f in range(len(FILTERS))], axis=1)
    return {
        "kept": counts.sum(axis=1)[:, None, None] - np.cumsum(gone, axis=2),
        "removed": gone,
        "redundant": (counts @ has)[:, letter] - gone,
        "unique_fails": counts[:, 1 << np.arange(len(FILTERS))][:, letter],
        "good_lost": removed(good),
        "toxic_lost": removed(toxic),
        "shapley": by_letter[:, letter],
    }


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For every part, order and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley."""
    per = cells(docs, labels, id_col, text_col, source_col)
    per = per.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS):
                names, own = batch.column(0)[lo:lo + PARTS].to_pylist(), batch.column(1)[lo:lo + PARTS].to_pylist()
                n = np.zeros((3, len(names), 1 << len(FILTERS)), np.int64)
                for i, found in enumerate(own):
                    for c in found:
                        n[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
                out = totals(*n)
                steps = len(FILTERS)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p for p in names for _ in range(steps * len(ORDERS))], pa.string()),
                    "filter_order": pa.array([o for _ in names for o in ORDERS for _ in range(steps)], pa.string()),
                    "step": pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names) * len(ORDERS))),
                    **{k: pa.array(v.reshape(-1), pa.int64()) for k, v in out.items()}})

    return per.mapInArrow(run, REPORT)
