"""Quality classifier: ordinal regression with a cumulative link.

Grades 0 .. K-1 are ordered; P(grade <= j) = sigmoid(t_j - s) with ascending
thresholds t_j and one score s shared by all grades. s is the sum of the weights
of a text's hashed features: the words (letters and digits in lower case), their
first five characters, and their shapes (letters, digits and the punctuation that
hangs on them). Words end at ASCII white space; one of several pieces, or a very
long one, counts by its pieces too. Each feature counts once a text.

The model is fitted on a sample of at most ``SAMPLE`` graded documents (those with
the smallest hashes of their ids), by AdaGrad with an L1 term, on features that
occur in ``LEAST`` or more documents of the sample (in ``SHARE`` of them, and in two
at least, if that is less); every document is scored over its whole text. The expected grade and the tail probabilities P(grade >= j) are
returned; documents with P(grade >= cut) of ``KEEP`` or more are kept (below one
half: losing a good document costs more than keeping a middling one, and bad
documents score far below it).

Defined cases: a null or empty text has no features, and its score is 0; graded
rows with a null id or grade, or without a document, are left out; of several
grades of one id the lowest counts; repeated documents are judged one by one (in
the sample an id has one document, that of the least text); P = ``KEEP`` is kept; without any graded document every grade is equally
likely; an empty table gives no rows; documents keep their columns in ``kept_documents``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.storage import check_columns, handed_back
from upkeep.llm.words import runs

BITS = 18
SAMPLE = 8_000
LEAST, SHARE = 8, 0.02
MEMO_WORDS = 200_000
SLICE = 1000
ROUNDS, MOST_ROUNDS, STEPS = 120, 400, 240_000
KEEP = 0.2
LONG = 20
MANY = 60


@dataclass
class Model:
    thresholds: np.ndarray  # K - 1 values, ascending
    features: np.ndarray  # numbers of the features with a weight
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.features] = self.weights
        return out

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. K-1, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def word_features(word: bytes) -> tuple[int, ...]:
    """Numbers of a word's features: its shape, its letters and digits, and their
    first five. A word of several pieces (runs of letters and digits) has those of
    each piece too, and a piece of over ``LONG`` characters its runs of five
    characters, so all of a long word counts."""
    text = word.decode("utf-8", "replace")
    shape, last = [], ""
    for c in text:
        kind = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if kind != last:
            shape.append(kind)
            last = kind
    pieces = "".join([c if c.isalnum() else " " for c in text.lower()]).split()
    core = "".join(pieces)
    names = [f"s{''.join(shape)}"]
    if core:
        names += [f"w{core}", f"p{core[:5]}"]
    if len(pieces) > 1:
        names += [n for p in pieces for n in (f"w{p}", f"p{p[:5]}")]
    names += [f"p{p[k:k + 5]}" for p in pieces if len(p) > LONG for k in range(5, len(p), 5)]
    return tuple(zlib.crc32(n.encode()) >> (32 - BITS) for n in names)


class FeatureTable:
    """Features of words, kept by word for a worker: row numbers into a table of
    three to a row. Words of more features have further rows; those of many are
    not kept."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.more: dict[bytes, range] = {}
        self.table = np.zeros((1024, 3), np.int32)
        self.used = 0

    def learn(self, word: bytes) -> tuple[int, ...]:
        """Add a word; the features of one that is not kept."""
        own = word_features(word)
        if len(own) > MANY:
            return own
        n = -(-len(own) // 3)
        while self.used + n > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used:self.used + n].flat = own + own[:1] * (3 * n - len(own))
        self.row[word] = self.used
        if n > 1:
            self.more[word] = range(self.used + 1, self.used + n)
        self.used += n
        return ()

    def text(self, words: list[bytes]) -> np.ndarray:
        """The distinct features of a text, ascending."""
        distinct = set(words)
        if len(self.row) + len(distinct) > MEMO_WORDS:
            self.clear()
        loose = [own for w in distinct.difference(self.row) if (own := self.learn(w))]
        rows = [self.row[w] for w in distinct if w in self.row]
        rows += [r for w in self.more.keys() & distinct for r in self.more[w]]
        return np.unique(np.concatenate([self.table[rows].ravel(), *(np.array(own, np.int32) for own in loose)]) if rows or loose else np.zeros(0, np.int32))


def text_features(column: pa.Array, table: FeatureTable) -> Iterator[np.ndarray]:
    for lo, hi, block in runs(column):
        for i in range(hi - lo):
            yield table.text(block.strings(i))


_tables: list[FeatureTable] = []


def _table() -> FeatureTable:
    if not _tables:
        _tables.append(FeatureTable())
    return _tables[0]


def sample_of(docs: DataFrame, grades: DataFrame, sample: int, id_col: str, text_col: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of the graded sample (at most ``sample`` ids)."""
    graded = grades.select(F.col(id_col).cast("long").alias("id"), "grade").dropna().groupBy("id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(text_features(batch.column(2), _table())), pa.list_(pa.int32()))],
                                             ["id", "grade", "features"])

    joined = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    joined = joined.groupBy("id", "grade").agg(F.min("text").alias("text"))
    found = joined.select("id", "grade", "text").mapInArrow(run, "id long, grade int, features array<int>").toArrow().combine_chunks()
    order = np.argsort(found["id"].to_numpy(), kind="stable")  # rows arrive in any order: the fit must not depend on it
    lists = pa.concat_arrays(found["features"].chunks) if found.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()  # no Python object a feature
    return [flat[ends[i]:ends[i + 1]] for i in order], found["grade"].to_numpy().astype(np.int64)[order]


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int | None = None, rate: float = 0.3, l1: float = 5e-4) -> Model:
    """Cumulative-link regression by full-batch AdaGrad with an L1 term. A small
    sample gets more rounds: about ``STEPS`` steps over documents in all."""
    rounds = rounds or min(MOST_ROUNDS, max(ROUNDS, STEPS // max(1, len(grades))))
    even = -np.log(1 / (np.arange(1, n_grades) / n_grades) - 1)
    if not len(grades):
        return Model(even, np.zeros(0, np.int64), np.zeros(0))
    lengths = np.array([len(f) for f in features])
    flat = np.concatenate(features)
    frequency = np.bincount(flat, minlength=1 << BITS)
    least = min(LEAST, max(2, round(SHARE * len(grades))))
    used = np.flatnonzero((frequency >= least) & (frequency < len(grades)))
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used))
    column = number[flat]
    del flat
    doc = np.repeat(np.arange(len(grades), dtype=np.int32), lengths)[column >= 0].astype(np.int64)
    column = column[column >= 0].astype(np.int64)

    below = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades)
    start = np.log(np.clip(below, 1e-3, 1 - 1e-3) / (1 - np.clip(below, 1e-3, 1 - 1e-3)))
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    weights = np.zeros(len(used))
    w_sum, t_sum = np.full(len(used), 1e-8), np.full(n_grades - 1, 1e-8)
    for _ in range(rounds):
        thresholds = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(doc, weights[column], minlength=len(grades))
        low = np.concatenate([[-np.inf], thresholds])[grades]
        high = np.concatenate([thresholds, [np.inf]])[grades]
        at_low, at_high = (1 / (1 + np.exp(-np.clip(x - score, -40, 40))) for x in (low, high))
        at_low[grades == 0], at_high[grades == n_grades - 1] = 0, 1
        mass = np.maximum(at_high - at_low, 1e-9)
        d_high, d_low = at_high * (1 - at_high) / mass, at_low * (1 - at_low) / mass
        g_score = (d_high - d_low) / len(grades)  # of the negative log likelihood
        g_threshold = np.zeros(n_grades - 1)
        np.add.at(g_threshold, grades[grades < n_grades - 1], -d_high[grades < n_grades - 1] / len(grades))
        np.add.at(g_threshold, grades[grades > 0] - 1, d_low[grades > 0] / len(grades))
        g_weight = np.bincount(column, g_score[doc], minlength=len(used))
        w_sum += g_weight ** 2
        step = rate / np.sqrt(w_sum)
        weights -= step * g_weight
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * l1, 0)
        g_first, g_gaps = g_threshold.sum(), np.array([g_threshold[j + 1:].sum() * np.exp(gaps[j]) for j in range(n_grades - 2)])
        moves = np.concatenate([[g_first], g_gaps])
        t_sum += moves ** 2
        change = rate * moves / np.sqrt(t_sum)
        first, gaps = first - change[0], gaps - change[1:]
    thresholds = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    some = np.flatnonzero(weights)
    return Model(thresholds, used[some], weights[some])


def train(docs: DataFrame, grades: DataFrame, n_grades: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit to ``grades`` (id, grade 0 .. n_grades - 1)."""
    check_columns(docs, id_col, text_col)
    check_columns(grades, id_col, "grade")
    return fit(*sample_of(docs, grades, sample, id_col, text_col), n_grades)


def _scores(texts: pa.Array, model: Model, weights: np.ndarray) -> np.ndarray:
    """The tail probabilities of texts, a row each."""
    return model.tails(np.array([weights[f].sum() for f in text_features(texts, _table())]))


def judge(docs: DataFrame, model: Model, cut: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_tail (P(grade >= cut)) and kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            tails = _scores(batch.column(1), model, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1), pa.float64()), pa.array(tails[:, cut - 1], pa.float64()),
                                              pa.array(tails[:, cut - 1] >= KEEP)], ["doc_id", "expected_grade", "p_tail", "kept"])

    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_tail double, kept boolean")


def kept_documents(docs: DataFrame, model: Model, cut: int = 2, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that are rejected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                yield part.filter(pa.array(_scores(part.column(at), model, weights)[:, cut - 1] >= KEEP))
        _table().clear()  # the worker's next task may be of another operator
        handed_back()

    return docs.mapInArrow(run, docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of a label table: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))
