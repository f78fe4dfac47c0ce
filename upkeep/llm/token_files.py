"""Flat token files: unsigned integers plus 64-bit document offsets.

``write_tokens`` tokenizes whole texts and writes, for every range partition
of the ids, three files that can be memory-mapped:

* ``tokens-PPPPP.bin``: token ids of the partition's documents, one after the
  other, little-endian unsigned (16 bits if every id fits, else 32);
* ``offsets-PPPPP.bin``: int64, documents + 1 entries, start of each document
  within the partition's tokens;
* ``ids-PPPPP.bin``: int64 document ids (0 for a null id);
* ``nulls-PPPPP.bin``: one byte a document, 1 where the id is null.

Partitions hold ascending id ranges, so the position of a document in the
whole stream is its local offset plus its partition's base; the bases are the
prefix sums of the partitions' token counts. A retried task writes the same
bytes under a temporary name and moves it into place.

Defined cases: a null or empty text gives the end id alone; repeated ids and
repeated rows are kept, ordered by (id, text); a null id sorts first; an
empty table gives no rows; further columns are ignored.

Encoding: ``unit_ids``, the tokenizers library on the distinct units of a block.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.llm.storage import check_columns, fresh_dir, mounted
from upkeep.llm.unit_ids import encoded_blocks

MANIFEST = "part int, docs long, tokens long"


def _place(folder: str, name: str, data: bytes | None, moved: str | None = None) -> None:
    temp = moved or f"{folder}/.{name}.{uuid.uuid4().hex}"
    if data is not None:
        with open(temp, "wb") as f:
            f.write(data)
    os.replace(temp, f"{folder}/{name}")


def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 1, dtype: str = "<u2",
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` below ``out_dir``; returns the manifest
    (part, docs, tokens, base), stored with the files as Parquet."""
    check_columns(docs, id_col, text_col)
    folder = mounted(out_dir)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        os.makedirs(folder, exist_ok=True)
        ids, nulls, lengths = [], [], []
        temp = f"{folder}/.tokens-{part:05d}.bin.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            for batch in batches:
                ids.append(batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                for _, _, block, bounds in encoded_blocks(batch.column(1), tokenizer_path, end_id, dtype):
                    f.write(block.tobytes())
                    lengths.append(np.diff(bounds))
        if not lengths:
            os.remove(temp)
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        _place(folder, f"offsets-{part:05d}.bin", offsets.tobytes())
        _place(folder, f"ids-{part:05d}.bin", np.concatenate(ids).astype("<i8").tobytes())
        _place(folder, f"nulls-{part:05d}.bin", np.concatenate(nulls).astype(np.uint8).tobytes())
        _place(folder, f"tokens-{part:05d}.bin", None, temp)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": [len(offsets) - 1], "tokens": [int(offsets[-1])]})

    ranged = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
              .repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text"))
    ranged.mapInArrow(write, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return manifest(docs.sparkSession, out_dir)


def manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per partition file, with its base in the whole stream."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")
            .withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))))


def read_tokens(spark: SparkSession, out_dir: str, dtype: str = "<u2", with_tokens: bool = False) -> DataFrame:
    """Documents as the files have them: doc_id, start, n_tokens, ids_crc32 of the
    ids as little-endian unsigned 32-bit integers and, if asked for, tokens."""
    folder = mounted(out_dir)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids = np.memmap(f"{folder}/ids-{part:05d}.bin", "<i8", "r")
                nulls = np.memmap(f"{folder}/nulls-{part:05d}.bin", np.uint8, "r")
                offsets = np.memmap(f"{folder}/offsets-{part:05d}.bin", "<i8", "r")
                tokens = np.memmap(f"{folder}/tokens-{part:05d}.bin", dtype, "r")
                for lo in range(0, len(ids), 1000):
                    own = ids[lo:lo + 1000]
                    cut = offsets[lo:lo + len(own) + 1]
                    out = {
                        "doc_id": pa.array(own, pa.int64(), mask=nulls[lo:lo + len(own)] == 1),
                        "start": pa.array(cut[:-1] + base, pa.int64()),
                        "n_tokens": pa.array(np.diff(cut), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64()),
                    }
                    if with_tokens:
                        out["tokens"] = pa.array([tokens[a:b].astype(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", tokens array<long>" if with_tokens else "")
    files = manifest(spark, out_dir).select("part", "base")
    # a fixed number: adaptive execution would put the short file list into one task
    return files.repartition(max(1, files.count()), "part").mapInArrow(read, schema)


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to a fresh shared folder and read the files back."""
    out_dir = fresh_dir(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, out_dir, end_id)
    return read_tokens(docs.sparkSession, out_dir)
