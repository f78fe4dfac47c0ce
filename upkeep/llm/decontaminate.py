"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters and digits after lower-casing A-Z (every non-ASCII
character counts as a letter). Each benchmark item gives its windows of ``size``
consecutive words; an item of fewer words, but not none, is one window. The
windows are a broadcast hash set: a document's word windows are looked up by
a 64-bit hash in the row, and a hit is verified on the words themselves.

Broadcasting is bounded: up to ``MAX_SET`` distinct windows are sent with the
plan; beyond, windows are matched by a shuffled join on the hash, verified
alike, with the same results.

Defined cases: null and empty texts have no words and no hits; an empty
benchmark hits nothing; repeated rows (of either table) are judged one by one and
kept; items with a null id hit but are not listed; documents keep all their
columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm.storage import check_columns, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_SET = 20_000


def words_of(text: Column) -> Column:
    """Array of the normalised words; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _starts(words: str, size: int) -> str:
    return f"if(size({words}) >= {size}, sequence(1, size({words}) - {size} + 1), cast(array() AS array<int>))"


def benchmark_windows(benchmark: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the benchmark: window (words joined by a space), len,
    hash and items (ids of the items that hold it)."""
    check_columns(benchmark, id_col, text_col)
    words = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("len", F.least(F.size("words"), F.lit(size)))
    pos = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1))
    cut = words.select("item", "len", "words", pos.alias("pos")).select("item", "len", F.expr("slice(words, pos, len)").alias("own"))
    return (cut.groupBy(F.array_join("own", " ").alias("window"), "len", _hash("own").alias("hash"))
            .agg(F.collect_set("item").alias("items")))


def _hash(words: str) -> Column:
    return F.expr(f"xxhash64(transform({words}, w -> xxhash64(w)))")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mark(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of a document), ``words`` and ``hits`` (struct pos, len:
    the verified windows, pos from 1)."""
    check_columns(docs, text_col)
    cut = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), words_of(F.col(f"`{text_col}`")).alias("words"))
    listed = windows.select("window", "len", "hash").limit(MAX_SET + 1).collect()
    if len(listed) > MAX_SET:
        return _mark_joined(cut, windows)
    found = ["cast(array() AS array<struct<pos:int,len:int>>)"]
    for size in sorted({r["len"] for r in listed}):
        own = [r for r in listed if r["len"] == size]
        hashes = ",".join(sorted({f"{r['hash']}L" if r["hash"] > -(1 << 63) else "-9223372036854775807L - 1L" for r in own}))
        texts = ",".join(_quoted(r["window"]) for r in own)
        at = f"filter({_starts('w', size)}, i -> xxhash64(slice(c, i, {size})) IN ({hashes}) AND array_join(slice(w, i, {size}), ' ') IN ({texts}))"
        found.append(f"transform({at}, p -> named_struct('pos', p, 'len', {size}))")
    # w and c are bound as lambda variables: computed once a row and not for every position
    marked = f"transform(array(words), w -> transform(array(transform(w, x -> xxhash64(x))), c -> named_struct('words', w, 'hits', concat({', '.join(found)})))[0])[0]"
    return cut.select("row", F.expr(marked).alias("marked")).select("row", "marked.words", "marked.hits")


def _mark_joined(cut: DataFrame, windows: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: a shuffled join on the hash."""
    cut = cut.select("row", "words", F.expr("transform(words, w -> xxhash64(w))").alias("codes"))
    cut = written(cut.select(F.monotonically_increasing_id().alias("uid"), "*"), "decontam")
    lengths = [r[0] for r in windows.select("len").distinct().collect()]  # at most ``size`` rows
    parts = None
    for size in lengths:
        own = cut.select("uid", F.explode(F.expr(f"transform({_starts('words', size)}, i -> struct(i AS pos, xxhash64(slice(codes, i, {size})) AS hash))")).alias("w"))
        own = own.select("uid", "w.pos", "w.hash", F.lit(size).alias("len"))
        parts = own if parts is None else parts.unionAll(own)
    near = parts.join(windows.select("hash", "len", "window"), ["hash", "len"])
    near = near.groupBy("uid").agg(F.collect_list(F.struct("pos", "len", "window")).alias("near"))
    checked = F.expr("transform(filter(near, h -> array_join(slice(words, h.pos, h.len), ' ') = h.window), h -> struct(h.pos AS pos, h.len AS len))")
    return cut.join(near, "uid", "left").select("row", "words", F.coalesce(checked, F.array().cast("array<struct<pos:int,len:int>>")).alias("hits"))


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a window that occurs),
    n_items, items_sha256 (of the items' ids, sorted as strings and
    comma-joined), contaminated."""
    windows = written(benchmark_windows(benchmark, size), "windows")
    small = windows.count() <= MAX_SET
    marked = mark(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), windows)
    covered = F.expr("size(array_distinct(flatten(transform(hits, h -> sequence(h.pos, h.pos + h.len - 1)))))")
    texts = F.expr("transform(hits, h -> array_join(slice(words, h.pos, h.len), ' '))")
    numbered = marked.select(F.monotonically_increasing_id().alias("uid"), F.col("row.doc_id").alias("doc_id"),
                             F.size("words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"),
                             F.array_distinct(texts).alias("texts"))
    flat = numbered.select("uid", "doc_id", "n_words", "n_hit", F.explode_outer("texts").alias("window"))
    owners = windows.select("window", "items")
    owned = flat.join(F.broadcast(owners) if small else owners, "window", "left")
    per = owned.groupBy("uid", "doc_id", "n_words", "n_hit").agg(F.collect_list("items").alias("items"))
    ids = F.expr("array_sort(array_distinct(transform(flatten(items), i -> cast(i AS string))))")
    per = per.select("doc_id", "n_words", "n_hit", ids.alias("ids"))
    return per.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", remove: str = "documents") -> DataFrame:
    """``docs`` without benchmark passages. ``remove="documents"`` drops every
    document with a hit; ``"spans"`` keeps them, with the normalised words
    outside the hits as their text. Clean documents stay as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, got {remove}")
    marked = mark(docs, written(benchmark_windows(benchmark, size), "windows"), text_col)
    if remove == "documents":
        return marked.where(F.size("hits") == 0).select("row.*")
    hit = F.expr("array_distinct(flatten(transform(hits, h -> sequence(h.pos, h.pos + h.len - 1))))")
    left = marked.select("row", "hits", "words", hit.alias("hit")).withColumn(
        "left", F.expr("array_join(filter(words, (w, i) -> NOT array_contains(hit, i + 1)), ' ')"))
    own = F.col(f"row.`{text_col}`")
    return left.select(*(F.when(F.size("hits") == 0, own).otherwise(F.col("left")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
