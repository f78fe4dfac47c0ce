"""Exact top-k inner-product search in three phases with a uniform threshold.

Components are turned into integers, floor(scale * x). A score is the sum of
``lists`` partial scores over slices of the dimensions; each block of candidate
rows holds such lists for its rows, and nothing but short lists leaves it.

1. *Gather*: every block takes, for every query, the k best entries of each
   partial list, resolves their full scores and sends the k best of them. Per
   query, the k-th best of all that came is a score that k candidates reach:
   a safe cutoff T.
2. *Broadcast and collect*: the cutoffs go to all blocks. A candidate of score
   T or more has a partial score of T / lists or more in some list, so a block
   collects exactly the entries that reach that uniform threshold.
3. *Resolve*: what is still missing of the collected entries' scores is added
   exactly, in the block; those below T go, and the block sends its k best (by
   score, then smaller id). The best k of these are the answer: no candidate is
   cut that could be in it.

Queries go out in chunks of about ``CHUNK`` vectors (the broadcast's bound);
candidates stay where they are read, and a block sends k rows per query at most,
however many candidates tie.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; vectors of another length than the query's are no
candidates for it; rows with the query's id are none either; a repeated row is a
candidate each time; a query id that occurs with several vectors is asked with
the smallest of them; empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.llm.storage import check_columns, written

CHUNK = 4096
BLOCK_CELLS = 1 << 21
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    check_columns(vectors, id_col, vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & fine)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by length: {length: (row numbers, matrix)}."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy() - column.offsets.to_numpy()[0]
    out = {}
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out[int(n)] = rows, flat[starts[rows][:, None] + np.arange(n)]
    return out


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices in the fastest type in which inner products are exact."""
    top = [max(1, int(np.abs(m).max(initial=0))) for m in matrices]
    bound = matrices[0].shape[1] * top[0] * top[1]
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return [m.astype(kind) for m in matrices]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score down, id up)."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _search(queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, lists: int, resolve: bool):
    """Map function over candidate batches; ``queries``: {length: (ids, vectors, cutoffs)}."""

    def block(q_ids, q, cuts, c_ids, c) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        q, c = _exact(q, c)
        slices = np.array_split(np.arange(q.shape[1]), min(lists, q.shape[1]))
        parts = [q[:, s] @ c[:, s].T for s in slices]
        if resolve:
            threshold = cuts[:, None] / len(parts)
            collected = np.any([p >= threshold for p in parts], axis=0)
        elif (n := len(c_ids)) > k + 1:  # one more: the query's own row may be among them
            collected = np.zeros(parts[0].shape, bool)
            for p in parts:
                np.put_along_axis(collected, np.argpartition(p, n - k - 1, axis=1)[:, n - k - 1:], True, axis=1)
        else:
            collected = np.ones(parts[0].shape, bool)
        at, cand = np.nonzero(collected)
        total = sum(p[at, cand].astype(np.int64) for p in parts)
        keep = q_ids[at] != c_ids[cand]
        if resolve:
            keep &= total >= cuts[at]
        at, cand, total = at[keep], cand[keep], total[keep]
        first = np.searchsorted(at, np.arange(len(q_ids) + 1))
        for i in np.flatnonzero(np.diff(first)):
            own_c = cand[first[i]:first[i + 1]]
            scores = total[first[i]:first[i + 1]]
            keep = _best(scores, c_ids[own_c], k)
            yield np.full(len(keep), q_ids[i]), c_ids[own_c[keep]], scores[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column(0).to_numpy()
            found = []
            for n, (rows, c) in _matrix(batch.column(1)).items():
                if n not in queries:
                    continue
                q_ids, q, cuts = queries[n]
                step = max(1, BLOCK_CELLS // max(1, len(rows)))
                for lo in range(0, len(q_ids), step):
                    cut = None if cuts is None else cuts[lo:lo + step]
                    found += block(q_ids[lo:lo + step], q[lo:lo + step], cut, all_ids[rows], c)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, lists: int = 2,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best of all other rows for each row whose id is divisible by ``every``:
    query_id, rank (from 1), vec_id, score."""
    rows = quantised(vectors, scale, id_col, vector_col)
    asked = written(rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "queries")
    chunks = max(1, -(-asked.count() // CHUNK))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    answers = None
    for i in range(chunks):
        own = asked.where(F.col("chunk") == i).select("query_id", "v").toArrow()
        ids = own.column(0).to_numpy()
        if not len(ids):
            continue
        by_length = {n: (ids[r], m) for n, (r, m) in _matrix(own.column(1).combine_chunks()).items()}
        gather = _search({n: (q, m, None) for n, (q, m) in by_length.items()}, k, lists, False)
        gathered = _ranked(rows.mapInArrow(gather, FOUND), k)
        # with fewer than k candidates gathered nothing is cut: the lowest score comes from all of them
        reached = gathered.groupBy("query_id").agg(F.min("score").alias("cut"), F.count("*").alias("n")).toArrow()
        known = {q: c for q, c, n in zip(*(x.to_pylist() for x in reached.columns), strict=True) if n == k}
        lowest = -(1 << 62)
        with_cuts = {n: (q, m, np.array([known.get(x, lowest) for x in q.tolist()], np.int64)) for n, (q, m) in by_length.items()}
        found = _ranked(rows.mapInArrow(_search(with_cuts, k, lists, True), FOUND), k)
        answers = found if answers is None else answers.unionAll(found)
    if answers is None:
        answers = rows.sparkSession.createDataFrame([], FOUND + ", rank int")
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
