"""File sources and sinks.

All paths live under the session's shared checkpoint folder (or a folder the
caller passes); nothing is written to a machine-local temp folder on a
cluster. Reads are whole-file, distributed ``spark.read`` scans.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.session import checkpoint_dir
from upkeep.sources import csv_records

UNNAMED = re.compile(r"^(_c\d+|)$")
METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/upkeep-io/{name}-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------------ S1 / S6
CSV_WRITE = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


NULL_MARKER = "\\N"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", null_value: str | None = None) -> str:
    """CSV with a header; whitespace kept; an empty frame still writes the header.
    ``null_value`` (e.g. ``NULL_MARKER``) keeps NULL apart from empty text."""
    w = df.write.mode(mode).options(**CSV_WRITE)
    if null_value is not None:
        w = w.option("nullValue", null_value)
    w.csv(path)
    return path


CSV_READ = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             null_value: str | None = None, multi_line: bool = True) -> DataFrame:
    """Whole-file CSV scan; a quote inside a quoted field is doubled. Without a schema
    every column is read as text, so one later aggregation pass (P2 / M6) decides the
    types. ``multi_line``: a first pass looks for quoted fields that hold line breaks;
    files with some are cut into records by all tasks (``csv_records``), others are
    read by Spark line by line."""
    options = CSV_READ | ({} if null_value is None else {"nullValue": null_value})
    reader = spark.read.options(**options)
    splits = csv_records.split_summaries(spark, path) if multi_line else None
    if splits is None or splits.where("opens").isEmpty():
        return (reader if schema is None else reader.schema(schema)).csv(path)
    schema = schema or reader.option("multiLine", "true").csv(path).schema
    fields = F.from_csv("value", schema.toDDL(), options | {"multiLine": "true"})
    return csv_records.records(spark, path, splits).select(fields.alias("r")).select("r.*")


# ------------------------------------------------------------------ S3
def validate_source(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".csv",)) -> list[str]:
    """Extension and existence checks (metadata only)."""
    problems = []
    if not any(path.lower().rstrip("/").endswith(e) for e in extensions) and "." in path.rsplit("/", 1)[-1]:
        problems.append(f"Unsupported file extension. Expected one of {extensions}.")
        return problems
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        problems.append(f"File not found: {path}")
    return problems


def bad_record_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records that do not fit ``schema``, counted in one pass over them as text: one with
    fewer or more fields than the header, or with a non-empty value that does not cast
    to its type, is bad. A line break in a quoted field is part of its record."""
    corrupt = "__corrupt"
    splits = csv_records.split_summaries(spark, path)
    options = CSV_READ | {"columnNameOfCorruptRecord": corrupt}
    names = spark.read.options(**options, multiLine="true").csv(path).columns
    plain = T.StructType([T.StructField(c, T.StringType()) for c in [*names, corrupt]])
    if splits.where("opens").isEmpty():
        text = spark.read.schema(plain).options(**options, columnPruning="false").csv(path)
    else:
        fields = F.from_csv("value", plain.toDDL(), options | {"multiLine": "true", "columnPruning": "false"})
        text = csv_records.records(spark, path, splits).select(fields.alias("r")).select("r.*")
    bad = F.col(corrupt).isNotNull()
    for f, c in zip(schema.fields, names):
        if not isinstance(f.dataType, T.StringType):
            value = F.col(f"`{c}`")
            bad = bad | (value.isNotNull() & (F.trim(value) != "") & value.try_cast(f.dataType).isNull())
    return text.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad_rows"))


# ------------------------------------------------------------------ S4
def trim_empty_columns(df: DataFrame) -> DataFrame:
    """Drop right-most columns with no header and no data; name the remaining
    unnamed ones ``column_<i>``. One ``count`` aggregation over the trailing
    unnamed candidates."""
    cols = df.columns
    tail = []
    for c in reversed(cols):
        if not UNNAMED.match(c):
            break
        tail.append(c)
    drop: set[str] = set()
    if tail:
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(tail)]).first()
        for i, c in enumerate(tail):  # right to left, stop at the first one with data
            if counts[f"n{i}"] > 0:
                break
            drop.add(c)
    keep = [c for c in cols if c not in drop]
    return df.select(*[F.col(f"`{c}`").alias(f"column_{i}" if UNNAMED.match(c) else c) for i, c in enumerate(keep)])


# ------------------------------------------------------------------ S5
def write_processed(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    problems = validate_source(spark, path, extensions=("",))
    if problems:
        raise FileNotFoundError(problems[0])
    return spark.read.parquet(path)


# ------------------------------------------------------------------ S7
def write_metrics(metrics: DataFrame, path: str) -> str:
    """One JSON record per (experiment, model), laid out as
    ``experiment=<e>/model=<m>/part-*.json``."""
    metrics.write.mode("overwrite").partitionBy("experiment", "model").json(path)
    return path


def metrics_long(spark: SparkSession, path: str) -> DataFrame:
    """Read every metrics file under ``path`` and return ``(experiment, model,
    metric, value)``. Experiment and model come from the folder layout
    (``experiment=…/model=…`` partitions, or ``<experiment>/<model>_metrics.json``
    via the file path)."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/experiment=*/model=*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.globStatus(pattern):
        df = spark.read.option("multiLine", "true").json(path)
    else:
        df = (spark.read.option("multiLine", "true").json(f"{path.rstrip('/')}/*/*_metrics.json")
              .withColumn("__p", F.col("_metadata.file_path"))
              .withColumn("experiment", F.regexp_extract("__p", r"/([^/]+)/[^/]+_metrics\.json$", 1))
              .withColumn("model", F.regexp_extract("__p", r"/([^/]+)_metrics\.json$", 1)).drop("__p"))
    # a metric that no file has gives NULL rows
    typed = df.select("experiment", "model", *[(F.col(m) if m in df.columns else F.lit(None)).cast("double").alias(m) for m in METRIC_NAMES])
    return typed.unpivot(["experiment", "model"], METRIC_NAMES, "metric", "value")
