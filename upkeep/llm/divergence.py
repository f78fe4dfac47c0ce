"""Source divergence audit: how far each source's words are from other sources'.

Terms are runs of ASCII letters and non-ASCII characters, A-Z in lower case. Each
language keeps the terms in at least ``LEAST_DOCS`` of its documents. A group
(lang, source) gives every kept term the smoothed share
p = 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)), in whole numbers.

Counting is a sort of pointers: a task takes shards of its texts as they lie in
Arrow's buffers, points at the start of every word and sorts the pointers by the
bytes behind them with multikey quicksort, eight bytes a character: a slice is
split by a pivot into smaller, equal and larger ones, equal slices go on with the
next eight bytes until their words end. Words that end equal are a run; its
documents and groups give document frequencies and counts. Runs are added up
map-side, then by (lang, source, term).

Sources of a language are compared in blocks of terms and of sources, so neither
the terms nor the sources of a language meet in one task: each block gives the
sums of |p - q| for its pairs of sources, which are the result's own rows. Terms
that both lack add the difference of their shares of 0 counts.

Defined cases: null text, lang and source are empty strings; a language without
kept terms has V = 0 and pairs of value 0; a group without terms takes part; a
language with one source has no pairs; equal values are ranked by item, in the
order of UTF-8 bytes; rows that share an id are documents of their own; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upkeep.llm.storage import check_columns, written
from upkeep.llm.unit_ids import blocks, run_positions, text_buffers

LEAST_DOCS = 30
ADDED = 5
SCALE = 1_000_000_000
TOP = 50
SHARD = 1 << 23
SMALL = 8192
TERM_BLOCK = 1024
SOURCE_BLOCK = 256

COUNTS = "lang string, source string, term string, n long, docs long"
SUMS = "lang string, a string, b string, value long"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of the texts between ``offsets``."""
    inside = _LETTER[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = inside[inner]
    end[inner - 1] = inside[inner - 1]
    at = np.flatnonzero(start)
    return at, np.flatnonzero(end) + 1 - at


def _characters(padded: np.ndarray, at: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each word from ``depth`` on, as a big-endian number; bytes
    behind its end are 0, which no word holds."""
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[at + depth]
    keys = np.ascontiguousarray(eight).view(">u8")[:, 0].astype(np.uint64)
    behind = np.clip(depth + 8 - length, 0, 8).astype(np.uint64) * np.uint64(8)
    return np.where(behind >= 64, np.uint64(0), keys >> np.minimum(behind, np.uint64(63)) << np.minimum(behind, np.uint64(63)))


def sorted_runs(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the words: their order, and where runs of equal
    words start in it."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    order = np.arange(len(at))
    key = _characters(padded, at, length, 0)  # of the pointer at each place of the order
    first = np.zeros(len(at), bool)
    slices = [(0, len(at), 0)]
    while slices:
        lo, hi, depth = slices.pop()
        if lo == hi:
            continue
        if hi - lo <= SMALL:
            order[lo:hi], first[lo:hi] = _small_slice(padded, at, length, order[lo:hi], key[lo:hi], depth)
            continue
        own, pointers = key[lo:hi], order[lo:hi]
        pivot = np.sort(own[::(hi - lo) // 63])[31]
        less, equal, more = np.flatnonzero(own < pivot), np.flatnonzero(own == pivot), np.flatnonzero(own > pivot)
        by = np.concatenate([less, equal, more])
        key[lo:hi], order[lo:hi] = own[by], pointers[by]
        a, b = lo + len(less), lo + len(less) + len(equal)
        first[a] = True
        slices += [(lo, a, depth), (b, hi, depth)]
        if pivot & np.uint64(0xFF):  # the words go on, or end here
            same = order[a:b]
            key[a:b] = _characters(padded, at[same], length[same], depth + 8)
            slices.append((a, b, depth + 8))
    return order, np.flatnonzero(first)


def _small_slice(padded: np.ndarray, at: np.ndarray, length: np.ndarray, order: np.ndarray, key: np.ndarray,
                 depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The end of the recursion: numpy's sort on each character for all runs of a
    slice at once. Returns the order and the marks of run starts."""
    by = np.argsort(key)
    order, key = order[by], key[by]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    live = np.arange(len(order))
    while True:
        alone = first & np.concatenate([first[1:], [True]])
        going = (key & np.uint64(0xFF) != 0) & ~alone[live]
        live = live[going]
        if not len(live):
            return order, first
        depth += 8
        own = order[live]
        key = _characters(padded, at[own], length[own], depth)
        run = np.cumsum(first[live])
        by = np.lexsort((key, run))
        order[live], key = own[by], key[by]
        first[live[1:]] |= key[1:] != key[:-1]


def shard_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts between ``offsets``, in groups ``group``: terms, group,
    occurrences and documents, one row per term and group."""
    data = _LOWER[data]
    at, length = words_at(data, offsets)
    order, starts = sorted_runs(data, at, length)
    sizes = np.diff(np.append(starts, len(order)))
    run = np.repeat(np.arange(len(starts)), sizes)
    rows, groups = len(offsets) - 1, int(group.max()) + 1 if len(group) else 1
    doc = np.searchsorted(offsets, at[order], "right") - 1
    pair, n = np.unique(run * rows + doc, return_counts=True)  # one per run and document
    cell, inverse, docs = np.unique(pair // rows * groups + group[pair % rows], return_inverse=True, return_counts=True)
    total = np.bincount(inverse, weights=n, minlength=len(cell)).astype(np.int64)
    chosen = order[starts[cell // groups]] if len(cell) else np.zeros(0, np.int64)
    lengths = length[chosen]
    raw = data[run_positions(at[chosen], lengths)]
    terms = pa.Array.from_buffers(pa.large_string(), len(cell), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)])), pa.py_buffer(raw)])
    return terms.cast(pa.string()), cell % groups, total, docs


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term)."""
    check_columns(docs, lang_col, source_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            names = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            for lo, hi in blocks(offsets, SHARD):
                seen: dict[tuple[str, str], int] = {}
                group = np.array([seen.setdefault((r["lang"], r["source"]), len(seen)) for r in names[lo:hi].to_pylist()])
                own = [pa.array(x, pa.string()) for x in zip(*seen, strict=True)]
                terms, of, n, found = shard_counts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], group)
                for a in range(0, len(of), 100_000):
                    at = pa.array(of[a:a + 100_000])
                    yield pa.RecordBatch.from_pydict({"lang": own[0].take(at), "source": own[1].take(at), "term": terms[a:a + 100_000],
                                                      "n": pa.array(n[a:a + 100_000], pa.int64()), "docs": pa.array(found[a:a + 100_000], pa.int64())})

    texts = docs.select(*_group(lang_col, source_col), F.col(f"`{text_col}`").alias("text"))
    return (texts.mapInArrow(run, COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _group(lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]


def _share(count: str, total: str) -> Column:
    """The smoothed share in exact decimals; 0 where the language has no terms."""
    over = f"cast({total} as decimal(38,0)) + {ADDED} * cast(v as decimal(28,0))"
    return F.expr(f"if(v = 0, 0L, 1 + (cast({count} + {ADDED} as decimal(27,0)) * cast({SCALE} as decimal(10,0))) div ({over}))")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS,
               top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    counts = written(term_counts(docs, lang_col, source_col, text_col), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = written(kept.drop("docs"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    held = written(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-held")
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = (docs.select(*_group(lang_col, source_col)).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
              .fillna(0, ["group_n", "v", "lang_n"]))
    groups = written(groups, "divergence-groups")

    shares = held.join(groups, ["lang", "source"]).select("lang", "source", "term", "v", _share("n", "group_n").alias("p"),
                                                           _share("all_n", "lang_n").alias("q"))
    ahead = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = ahead.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    sums = source_gaps(shares, groups.select("lang", "source", "v", _share("0", "group_n").alias("p")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def source_gaps(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: the sum of |p - q| over all kept terms for every two
    sources a < b of a language. ``shares`` has p where a source has the term,
    ``groups`` (lang, source, v, p) the share of no occurrence."""
    blocks_of = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCE_BLOCK).cast("int").alias("n_blocks"),
                                           F.greatest(F.lit(1), F.ceil(F.max("v") / TERM_BLOCK)).cast("int").alias("n_terms"))
    block = F.expr("pmod(xxhash64(source), n_blocks)").alias("own")
    other = F.explode(F.expr("sequence(0, n_blocks - 1)")).alias("other")
    groups = groups.join(blocks_of, "lang").select("lang", "source", "v", "p", "n_terms", block, "n_blocks")
    marks = (groups.select("*", other).select("*", F.explode(F.expr("sequence(0, n_terms - 1)")).alias("term_block"))
             .select("lang", "source", F.lit(None).cast("string").alias("term"), "p", "v", "own", "other", "term_block"))
    cells = (shares.join(blocks_of, "lang")
             .select("lang", "source", "term", "p", "v", block, "n_blocks", F.expr("cast(pmod(xxhash64(term), n_terms) as int)").alias("term_block"))
             .select("*", other).select("lang", "source", "term", "p", "v", "own", "other", "term_block"))

    def compare(table: pa.Table) -> pa.Table:
        lang, number = table.column("lang")[0], table.column("term_block")[0].as_py()
        mark = table.filter(pc.is_null(table.column("term"))).sort_by("source")
        cell = table.filter(pc.is_valid(table.column("term")))
        sources = mark.column("source").combine_chunks()
        own = mark.column("own").to_numpy()
        base = mark.column("p").to_numpy()
        coded = cell.column("term").combine_chunks().dictionary_encode()
        share = np.tile(base[:, None], (1, len(coded.dictionary)))
        row = pc.index_in(cell.column("source"), value_set=sources).to_numpy()
        share[row, coded.indices.to_numpy()] = cell.column("p").to_numpy()
        missing = (mark.column("v").to_numpy().max() if number == 0 else 0) - len(coded.dictionary)
        # two blocks: pairs across them; one block: its own pairs
        across = own.min() != own.max() or table.column("other")[0].as_py() != own[0]
        found = []
        for i in range(len(own)):
            js = np.flatnonzero((own != own[i]) & (np.arange(len(own)) > i)) if across else np.arange(i + 1, len(own))
            if len(js):
                found.append((np.full(len(js), i), js, np.abs(share[js] - share[i]).sum(axis=1) + missing * np.abs(base[js] - base[i])))
        a, b, value = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"lang": pa.repeat(lang, len(a)), "a": sources.take(pa.array(a)), "b": sources.take(pa.array(b)),
                         "value": pa.array(value, pa.int64())})

    keyed = cells.unionByName(marks).select("*", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    parts = keyed.groupBy("lang", "term_block", "x", "y").applyInArrow(compare, SUMS)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
