"""Repeated passages removed by matching statistics against suffix automata.

A window is ``length`` consecutive words of one document. A word goes if a window
that covers it occurs, word for word, in a document with a smaller id; windows
are judged on the input texts.

1. Every window holds at least one *anchor*: the smallest hash among its runs of
   ``GRAM`` words. Equal windows have equal anchors. A grouping by anchor finds
   those that occur in two documents; its owner is the smallest of them.
2. Windows with a shared anchor are cut out as runs, as long as the owner stays
   the same, and dealt to reference shards by owner: all documents that can share
   a window meet in one shard. (One automaton of everything could not be
   broadcast at any size of the corpus, so shards and the passages that can match
   them are brought together instead; both sides of a shard are bounded.)
3. A shard streams its runs in the order of the ids through a suffix automaton of
   the runs of smaller documents. The matching statistic, the length of the
   longest suffix read so far that the automaton holds, tells every repeated
   window, on the words themselves; then what is new in the run joins the
   automaton. Copies add nothing to it.
4. An owner with more than ``SHARD_WORDS`` words is dealt over several shards; the
   windows that are still new there are dealt again by their own words, and
   streamed once more.

Defined cases: null and empty texts have no words; a repeated id is judged
against smaller ids only, each row by itself; rows with a null id neither lose
words nor count as a source; an empty table gives no rows; other columns do not
matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.storage import check_columns, handed_back, release, written
from upkeep.llm.words import Words, runs, windows

GRAM = 7
SHARD_WORDS = 100_000
RUN = "owner long, uid long, doc_id long, at int, words int, text binary"


class SuffixAutomaton:
    """Suffix automaton of a set of sequences, grown one by one."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            to = nxt[last].get(c)
            if to is not None and length[to] == length[last] + 1:
                last = to
                continue
            if to is None:
                state = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = state
                    p = link[p]
                if p >= 0:
                    link[state] = self._split(p, c)
                last = state
            else:
                last = self._split(last, c)

    def _split(self, p: int, c: object) -> int:
        """The state of p's longest string followed by c."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[p][c]
        if length[q] == length[p] + 1:
            return q
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def statistics(self, sequence: list) -> list[int]:
        """For each place, the length of the longest suffix read that occurs here."""
        nxt, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for c in sequence:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(c)
            if to is not None:
                state = to
                matched += 1
            out.append(matched)
        return out


def _anchors(block: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, start word) of every window of a block, in order."""
    hashes = block.hashes()
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = windows(hashes, GRAM)
    least = grams[:n].copy()
    for j in range(1, length - GRAM + 1):
        np.minimum(least, grams[j:j + n], out=least)
    text = np.repeat(np.arange(len(block.first) - 1), np.diff(block.first))
    whole = np.flatnonzero(text[:n] == text[length - 1:])
    return least[whole], text[whole], whole


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, uid, doc_id), once for each stretch of windows with the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, block in runs(batch.column(2)):
                least, text, _ = _anchors(block, length)
                if len(least):
                    new = np.ones(len(least), bool)
                    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                    rows = lo + text[new]
                    yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(uid[rows]), pa.array(ids[rows])], ["anchor", "uid", "doc_id"])
        handed_back()

    return docs.where("doc_id IS NOT NULL").select("uid", "doc_id", "text").mapInArrow(run, "anchor long, uid long, doc_id long")


def shared_runs(docs: DataFrame, length: int) -> DataFrame:
    """The runs of windows whose anchor occurs in two documents (``RUN``)."""
    found = anchors(docs, length)
    owners = found.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    marks = found.join(owners.select("anchor", "owner"), "anchor").groupBy("uid").agg(F.collect_list(F.struct("anchor", "owner")).alias("marks"))
    marks = written(marks, "marks")
    release(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            marked = batch.column(3)
            for lo, hi, block in runs(batch.column(2)):
                least, text, start = _anchors(block, length)
                out: list[tuple] = []
                edge = np.searchsorted(text, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    _runs_of(block, i, least[edge[i]:edge[i + 1]], start[edge[i]:edge[i + 1]], marked[lo + i].values, length, [int(x[lo + i]) for x in ids], out)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RUN_TYPES, strict=True)], RUN_NAMES)

    joined = docs.select("uid", "doc_id", "text").join(marks, "uid").select("uid", "doc_id", "text", "marks")
    return joined.mapInArrow(cut, RUN)


RUN_NAMES = ["owner", "uid", "doc_id", "at", "words", "text"]
RUN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _runs_of(block: Words, i: int, least: np.ndarray, start: np.ndarray, marks: pa.StructArray, length: int, ids: list[int], out: list[tuple]) -> None:
    keys, owner = (marks.field(k).to_numpy() for k in (0, 1))
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    least = least.view(np.int64)
    place = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
    known = keys[place] == least
    own = np.where(known, owner[place], -1)
    change = np.ones(len(own), bool)
    change[1:] = (own[1:] != own[:-1]) | (known[1:] != known[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(own)) - 1
    for a, b in zip(first, last, strict=True):
        if known[a]:
            from_word, to_word = start[a], start[b] + length
            text = block.data[block.start[from_word]:block.end[to_word - 1]].tobytes()
            out.append((int(own[a]), *ids, int(from_word - block.first[i]), int(to_word - from_word), text))


def _stream(table: pa.Table, length: int) -> Iterator[tuple[int, int, int, int, list[bytes], bool]]:
    """Streams a shard: (row, at, from window, to window, words, repeated) of all stretches of its runs."""
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    ids = table.column("doc_id").to_numpy()[order]
    text = table.column("text").combine_chunks()
    automaton = SuffixAutomaton()
    waiting: list[list[bytes]] = []
    for k, row in enumerate(order.tolist()):
        if k and ids[k] != ids[k - 1]:
            for part in waiting:
                automaton.add(part)
            waiting = []
        words = text[row].as_py().split()
        repeated = np.array(automaton.statistics(words)[length - 1:]) >= length
        change = np.flatnonzero(np.diff(repeated)) + 1
        for a, b in zip([0, *change], [*change, len(repeated)], strict=True):
            yield row, a, b, words, bool(repeated[a])
            if not repeated[a]:
                waiting.append(words[a:b + length - 1])


def _shard_spans(length: int):
    """(uid, doc_id, at, words, text): a null text marks a span to remove; else a
    window that is new in this shard, if the shard's owner is split."""

    def run(table: pa.Table) -> pa.Table:
        uid, ids, at = (table.column(c).to_numpy() for c in ("uid", "doc_id", "at"))
        split = table.column("split").to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        for row, a, b, words, repeated in _stream(table, length):
            if repeated:
                out.append((uid[row], ids[row], at[row] + a, b - a + length - 1, None))
            elif split[row]:
                out += [(uid[row], ids[row], at[row] + i, length, b" ".join(words[i:i + length])) for i in range(a, b)]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, RUN_TYPES[1:], strict=True)], names=RUN_NAMES[1:])

    return run


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(uid, at, words): stretches of words to remove, from word ``at`` (from 0)."""
    found = written(shared_runs(docs, length), "runs")
    release(docs.sparkSession)
    sizes = found.groupBy("owner").agg(F.sum("words").alias("all_words"))
    shards = max(1, (found.agg(F.sum("words")).first()[0] or 0) // SHARD_WORDS)
    parts = F.ceil(F.col("all_words") / SHARD_WORDS)
    dealt = found.join(sizes, "owner").withColumn("split", parts > 1)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("owner", F.pmod(F.xxhash64("uid"), parts)), F.lit(shards)))
    schema = "uid long, doc_id long, at int, words int, text binary"
    one = written(dealt.groupBy("shard").applyInArrow(_shard_spans(length), schema), "spans")
    spans = one.where("text IS NULL").select("uid", "at", "words")
    new = one.where("text IS NOT NULL").withColumn("split", F.lit(False))
    again = max(1, (new.agg(F.sum("words")).first()[0] or 0) // SHARD_WORDS)
    new = new.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(again)))
    two = new.groupBy("shard").applyInArrow(_shard_spans(length), schema).where("text IS NULL")
    return spans.unionAll(two.select("uid", "at", "words"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, text, row): uid is the id if no id is repeated or null, else a
    number given to the rows of a written copy; row holds all columns."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "*")
    return written(rows.select(F.monotonically_increasing_id().alias("uid"), "*"), "numbered")


def _stripped(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, found): found holds n_words, n_removed, kept_sha256 and kept."""
    check_columns(docs, id_col, text_col)
    rows = _numbered(docs, id_col, text_col)
    spans = repeated_spans(rows.select("uid", "doc_id", "text"), length)
    spans = written(spans.groupBy("uid").agg(F.collect_list(F.struct("at", "words")).alias("spans")), "spans")
    release(docs.sparkSession)
    # else a condition on its result has Spark run it a second time, in a second worker beside the first
    keep = F.arrow_udf(_keep, "n_words long, n_removed long, kept_sha256 string, kept string").asNondeterministic()
    return rows.join(spans, "uid", "left").select("doc_id", "row", keep("text", "spans").alias("found"))


def _keep(texts: pa.Array, spans: pa.Array) -> pa.Array:
    total, removed, kept = [], [], []
    for lo, hi, block in runs(texts):
        for i in range(hi - lo):
            words = block.strings(i)
            total.append(len(words))
            if spans[lo + i].is_valid:
                gone = np.zeros(len(words), bool)
                own = spans[lo + i].values
                for at, n in zip(own.field(0).to_pylist(), own.field(1).to_pylist(), strict=True):
                    gone[at:at + n] = True
                words = [words[j] for j in np.flatnonzero(~gone)]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
    return pa.StructArray.from_arrays([
        pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string()),
    ], ["n_words", "n_removed", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined
    by one space) of every document."""
    return _stripped(docs, length, id_col, text_col).select("doc_id", "found.*")


def without_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without repeated passages. A text that loses nothing
    stays as it is; one that loses words becomes the words that stay, joined by one
    space; a document that loses all its words goes."""
    found = _stripped(docs, length, id_col, text_col)
    found = found.where((F.col("found.n_removed") == 0) | (F.col("found.n_removed") < F.col("found.n_words")))
    text = F.when(F.col("found.n_removed") == 0, F.col(f"row.`{text_col}`")).otherwise(F.col("found.kept"))
    return found.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
