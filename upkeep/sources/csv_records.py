"""Records of CSV files whose quoted fields hold line breaks, cut by many tasks.

Files are read as lines, in the usual splits. Whether a line begins inside a quoted
field depends on all lines before it, so three steps are taken:

1. each split is summed up by where it ends (inside a quoted field or not) for both
   ways it may begin;
2. the summaries of a file, one row a split, are composed in order by running sums,
   which gives the way every split really begins;
3. each split is cut into records from there. What belongs to a record that crosses
   splits is put together by (file, split in which the record begins); only splits
   with such a record are read for it again.

Splits are told apart by a 64-bit hash of the file's path and their start; step 2's
table goes to every task: some 40 bytes for each split, 32 MB for 100 TB in splits of
128 MB. A run whose splits are not those that were summed up is refused.

A quote opens a field only at the field's start; elsewhere it is text. Records end at
line feeds, with or without a carriage return before them. Empty lines are no records.
Line breaks inside a field stay as they are in the file.
A quoted field that is never closed takes the rest of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.session import cut_lineage

_REST = re.compile(r'(?:[^"]++|"")*+"')  # a quoted field from behind its first quote
_SUMMARY = "file long, start long, from_outside boolean, from_inside boolean, closes boolean, opens boolean"
_CUT = "file long, owner long, part long, header boolean, value string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins ``inside`` one."""
    at = 0
    while True:
        if inside:
            rest = _REST.match(line, at)
            if rest is None:
                return True
            at = rest.end()
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        at = line.find(",", at) + 1
        if at == 0:
            return False
        inside = False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _tables(rows: Iterator[tuple], names: list[str], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``size``."""
    types = [pa.int64() if n in ("file", "start", "owner", "part") else pa.string() if n == "value" else pa.bool_() for n in names]
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[tuple]:
        key, state = None, None
        for file, start, line in _rows(batches):
            if (file, start) != key:
                if key:
                    yield *key, *state
                key, state = (file, start), (False, True, False, False)
            outside, inside, closes, opens = state
            outside, inside = ends_inside(line, outside), ends_inside(line, inside)
            state = outside, inside, closes or not inside, opens or outside
        if key:
            yield *key, *state

    return _tables(run(), _names(_SUMMARY))


def split_summaries(spark: SparkSession, path: str) -> DataFrame:
    """file, start, from_outside, from_inside (state at the split's end for both ways to
    begin), closes (begun inside, a line ends outside), opens (begun outside, a line ends
    inside), one row a split; only lines with a quote come to Python."""
    lines = _lines(spark, path)
    quoted = lines.where(F.col("value").contains('"')).mapInArrow(_summed, _SUMMARY)
    same = {"from_outside": False, "from_inside": True, "closes": False, "opens": False}
    splits = lines.select("file", "start").distinct().join(quoted, ["file", "start"], "left")
    return cut_lineage(splits.na.fill(same))


def _begun(splits: DataFrame) -> DataFrame:
    """file, start, inside (how the split begins), owner (start of the split in which a
    record begins that is open there), crossing (a record crosses one of its borders)."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_outside") == F.col("from_inside")  # ends alike, however it begins
    turns = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int"))
    splits = splits.withColumn("turns", turns.over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(fixed, F.struct("from_outside", "turns")), ignorenulls=True).over(before)
    splits = splits.withColumn("last", last).withColumn("turned", F.coalesce(F.max("turns").over(before), F.lit(0)))
    odd = (F.col("turned") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    splits = splits.withColumn("inside", F.coalesce("last.from_outside", F.lit(False)) != odd)
    begins = F.when(F.col("inside"), F.col("from_inside") & F.col("closes")).otherwise(F.col("from_outside"))
    ends = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    return splits.select("file", "start", "inside", F.last(F.when(begins, F.col("start")), ignorenulls=True).over(before).alias("owner"),
                         (F.col("inside") | ends).alias("crossing"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[tuple]:
        key, open_lines, owner, inside, header = None, [], None, False, False
        for file, start, line, begins_inside, opened_in in _rows(batches):
            if (file, start) != key:
                if open_lines:
                    yield key[0], owner, key[1], header, "\n".join(open_lines)
                if begins_inside is None:
                    raise RuntimeError("the splits of the files have changed since they were summed up; read them again")
                key, open_lines, inside, header = (file, start), [], begins_inside, start == 0
                owner = opened_in if inside else None
            if not inside:
                owner = start
                if line in ("", "\r"):
                    continue
            begun_before = owner != start
            inside = ends_inside(line, inside) if inside or '"' in line else False
            open_lines.append(line)
            if inside:
                continue
            text = "\n".join(open_lines)
            open_lines = []
            if begun_before:
                yield file, owner, start, False, text
            elif header:
                header = False
            else:
                yield file, None, start, False, text.removesuffix("\r")
        if open_lines:
            yield key[0], owner, key[1], header, "\n".join(open_lines)

    return _tables(run(), _names(_CUT))


def records(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """value: the records of the files below ``path`` but the first of each file (its
    header), line breaks kept; ``splits`` from ``split_summaries``."""
    begun = _begun(splits)
    lines = _lines(spark, path).join(F.broadcast(begun), ["file", "start"], "left")

    def cut(part: DataFrame) -> DataFrame:
        return part.select("file", "start", "value", "inside", "owner").mapInArrow(_cut, _CUT)

    parts = F.sort_array(F.collect_list(F.struct("part", "value")))
    crossing = (cut(lines.where("crossing")).where("owner IS NOT NULL").groupBy("file", "owner")
                .agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"), F.max("header").alias("header"))
                .where("NOT header").select(F.regexp_replace("value", "\r$", "").alias("value")))
    return cut(lines).where("owner IS NULL").select("value").unionAll(crossing)
