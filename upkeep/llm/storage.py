"""Shared folders for intermediate tables and token files.

Everything an operator writes goes below ``spark.checkpoint.dir`` (see
``upkeep.session.checkpoint_dir``), in a folder with a fresh name, so it
outlives lost executors and no two runs meet.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from upkeep.session import checkpoint_dir


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the plan
    above starts from a table that any executor can read again."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``fresh_dir`` that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def mounted(path: str) -> str:
    """The file-system path of a folder that Python workers open directly. Memory
    mapping needs a shared mount, so other schemes are refused."""
    if match := re.match(r"file:/*(/.*)", path):
        return match[1]
    if path.startswith("/"):
        return path
    raise ValueError(f"memory-mapped files need a shared mounted folder, got {path}")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for steps that run at once inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "4m") -> contextlib.AbstractContextManager[None]:
    """Arrow batches of about ``size`` bytes to Python workers: an executor holds a
    batch twice, and the worker its arrays besides."""
    return setting(spark, BATCH_BYTES, size)


def default_small_batches(spark: SparkSession, size: str = "4m") -> None:
    """The same for the rest of the session, for results that are run after their
    operator has returned; a size that the session was started with stays."""
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, size)


def unsorted_buckets(spark: SparkSession, open_files: int = 64) -> contextlib.AbstractContextManager[None]:
    """Bucketed writes without a sort of the rows: a task keeps up to ``open_files``
    buckets open (beyond that it sorts). For rows that already lie by bucket."""
    return setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(open_files))


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Queries that are made and run inside drop their shuffle files when they end,
    not when the driver happens to collect garbage: steps that repeat a large
    shuffle keep the disk of one. None may be run twice."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def release(spark: SparkSession) -> None:
    """Have the driver collect garbage. Shuffle files of finished steps stay on
    the executors' disks until the driver drops the last reference to them; jobs
    of several large steps call this in between to keep the peak to one step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def handed_back() -> None:
    """In a Python worker, at the end of a heavy partition: give freed memory back to
    the system. Workers live on for other operators' tasks, and the C library and
    Arrow would keep it for them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass
