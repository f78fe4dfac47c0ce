"""Profiling and validation (P1-P8): full-table aggregation passes.

Every profile is computed in a fixed small number of passes over the data,
all columns at once, with partial (map-side) aggregation; results are long
tables with one row per source column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.columns import clean_text, parse_timestamp, strip_ws, to_double
from upkeep.schema import DATE_NAME_PATTERN, ID_NAME_PATTERN, MAX_INSPECT_ROWS, PREVIEW_ROWS

NUMERIC_NAMES = ("double", "float", "bigint", "int", "smallint", "tinyint")


def dtypes(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _is_numeric(t: str) -> bool:
    return t in NUMERIC_NAMES or t.startswith("decimal")


def _is_datetime(t: str) -> bool:
    return t in ("timestamp", "timestamp_ntz", "date")


def _lit_str_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ------------------------------------------------------------------ P2
def stripped_view(df: DataFrame) -> DataFrame:
    """Adds ``__t<i>`` = whitespace-stripped text of every string column, so the
    parse attempts below read one stripped value instead of re-stripping."""
    types = dtypes(df)
    extra = [strip_ws(F.col(f"`{c}`")).alias(f"__t{i}") for i, c in enumerate(df.columns) if types[c] == "string"]
    return df.select("*", *extra)


def dtype_class_aggs(df: DataFrame) -> list[Column]:
    """Per column: n non-null, n numeric-parseable, n datetime-parseable.
    Evaluate on ``stripped_view(df)``."""
    types = dtypes(df)
    aggs = []
    for i, c in enumerate(df.columns):
        t, x = types[c], F.col(f"`{c}`")
        s = F.col(f"__t{i}") if t == "string" else x
        aggs.append(F.count(x).alias(f"__nn{i}"))
        aggs.append(F.count(to_double(s, t, stripped=True)).alias(f"__num{i}"))
        aggs.append(F.count(parse_timestamp(s, t, stripped=True)).alias(f"__dt{i}"))
    return aggs


def _dtype_class(i: int, t: str) -> Column:
    nn, num, dt = F.col(f"__nn{i}"), F.col(f"__num{i}"), F.col(f"__dt{i}")
    if _is_numeric(t):
        return F.when(nn == 0, "empty").otherwise("numeric")
    if _is_datetime(t):
        return F.when(nn == 0, "empty").otherwise("datetime")
    return (
        F.when(nn == 0, "empty").when(num == nn, "numeric").when(dt == nn, "datetime").otherwise("text")
    )


def infer_dtypes(df: DataFrame) -> DataFrame:
    """``(column_name, ordinal, dtype)`` with dtype in empty/numeric/datetime/text."""
    types = dtypes(df)
    wide = stripped_view(df).agg(*dtype_class_aggs(df))
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"), _dtype_class(i, types[c]).alias("dtype"))
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def type_by_inference(df: DataFrame) -> DataFrame:
    """Decision rule for a string source: all-numeric columns become double,
    everything else stays as read (a column has one type: M6)."""
    classes = {r["column_name"]: r["dtype"] for r in infer_dtypes(df).collect()}  # one row per column
    types = dtypes(df)
    out = []
    for c in df.columns:
        if classes[c] == "numeric" and not _is_numeric(types[c]):
            out.append(to_double(F.col(f"`{c}`"), types[c]).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


# ------------------------------------------------------------------ P5
def missingness(df: DataFrame) -> DataFrame:
    """``(column_name, missing_pct)``: round(100·mean(isnull), 2); empty → 0.0."""
    aggs = [F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"__m{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    rows = [
        F.struct(F.lit(c).alias("column_name"),
                 F.coalesce(F.round(F.col(f"__m{i}") * 100, 2), F.lit(0.0)).alias("missing_pct"))
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ------------------------------------------------------------------ P1
def column_profile(df: DataFrame) -> DataFrame:
    """Per column: dtype class, missing count/%, three smallest distinct
    non-null values as text (a defined order: "first rows" has none here).

    Three aggregation passes over all columns at once: pass 1 carries
    counts, parse counts and the smallest value; passes 2-3 the next ones.
    """
    cols = df.columns
    types = dtypes(df)
    text = {c: F.col(f"`{c}`").cast("string") for c in cols}
    p1 = stripped_view(df).agg(
        F.count(F.lit(1)).alias("__n"),
        *dtype_class_aggs(df),
        *[F.min(text[c]).alias(f"__s1_{i}") for i, c in enumerate(cols)],
    )
    j = df.crossJoin(F.broadcast(p1.select("__n", *[f"__s1_{i}" for i in range(len(cols))])))
    p2 = j.agg(*[F.min(F.when(text[c] > F.col(f"__s1_{i}"), text[c])).alias(f"__s2_{i}") for i, c in enumerate(cols)])
    j2 = df.crossJoin(F.broadcast(p2))
    p3 = j2.agg(*[F.min(F.when(text[c] > F.col(f"__s2_{i}"), text[c])).alias(f"__s3_{i}") for i, c in enumerate(cols)])
    wide = p1.crossJoin(p2).crossJoin(p3)
    rows = []
    for i, c in enumerate(cols):
        missing = (F.col("__n") - F.col(f"__nn{i}")).cast("bigint")
        rows.append(F.struct(
            F.lit(c).alias("column_name"),
            F.lit(i).alias("ordinal"),
            _dtype_class(i, types[c]).alias("dtype"),
            missing.alias("missing_count"),
            F.when(F.col("__n") > 0, F.round(missing * 100.0 / F.col("__n"), 2)).otherwise(F.lit(0.0)).alias("missing_pct"),
            F.col(f"__s1_{i}").alias("sample_1"),
            F.col(f"__s2_{i}").alias("sample_2"),
            F.col(f"__s3_{i}").alias("sample_3"),
        ))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ------------------------------------------------------------------ P3 / C4
def duplicate_count(df: DataFrame) -> DataFrame:
    """``(n_rows, n_distinct, n_duplicates)``; nulls compare equal. One scan: the size of
    each group of equal rows gives all three, counted map-side."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    counts = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return counts.withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


# ------------------------------------------------------------------ P4 / S2
def preview(df: DataFrame, order: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows under an explicit order (top-k; the limit is the feature)."""
    return df.orderBy(*order).limit(n)


def inspect_bounded(df: DataFrame, order: list[str], max_rows: int = MAX_INSPECT_ROWS) -> DataFrame:
    """Profile only the first ``max_rows`` rows (by ``order``); ``is_partial_scan``
    tells whether more exist. The full-table ``column_profile`` is the scale path."""
    head = df.orderBy(*order).limit(max_rows + 1)
    prof = column_profile(df.orderBy(*order).limit(max_rows))
    flag = head.agg((F.count(F.lit(1)) > max_rows).alias("is_partial_scan"))
    return prof.crossJoin(flag)


def inspect_table(df: DataFrame, order: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """``column_profile`` of the whole table with its row count, distinct rows and
    duplicates, and the first ``n`` rows' values of the column (by ``order``) as text."""
    rank = F.struct(*[F.expr(o).alias(f"__o{i}") for i, o in enumerate(order)])
    text = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    first = preview(df, order, n).select(rank.alias("__o"), text.alias("__v"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("__o", "__v"))).alias("__first"))
    wide = column_profile(df).crossJoin(duplicate_count(df)).crossJoin(first)
    values = F.transform("__first", lambda r: F.element_at(r["__v"], F.col("ordinal") + 1))
    return wide.select("*", values.alias("preview")).drop("__first")


# ------------------------------------------------------------------ P6
def detect_datetime(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(column_name, is_datetime)``: typed datetime → yes; numeric or all-null
    → no; date-like name → yes; else parse rate over *all* non-null values >
    ``threshold`` (the full-table version of a 200-value sample)."""
    types = dtypes(df)
    wide = stripped_view(df).agg(*dtype_class_aggs(df))
    rows = []
    for i, c in enumerate(df.columns):
        t = types[c]
        nn, dt = F.col(f"__nn{i}"), F.col(f"__dt{i}")
        if _is_datetime(t):
            flag = F.lit(True)
        elif _is_numeric(t):
            flag = F.lit(False)
        else:
            name_hit = F.lit(c).rlike(DATE_NAME_PATTERN)
            flag = F.when(nn == 0, False).when(name_hit, True).otherwise(dt / nn > threshold)
        rows.append(F.struct(F.lit(c).alias("column_name"), flag.alias("is_datetime")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ------------------------------------------------------------------ P7
def detect_id_like(df: DataFrame, top_share: float = 0.9) -> DataFrame:
    """``(column_name, is_id_like)``: id-like name, or a string column with
    1 < distinct < rows and top-value share < ``top_share``.

    Exact and skew-safe: (column, value) counts are aggregated map-side first,
    then reduced per column, so a hot value never sits in one task alone."""
    types = dtypes(df)
    str_cols = [c for c in df.columns if types[c] == "string"]
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    spark = df.sparkSession
    if str_cols:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("v")) for c in str_cols
        ])).alias("r")).select("r.*").where(F.col("v").isNotNull())
        per_value = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("cnt"))
        stats = per_value.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("nunique"), F.max("cnt").alias("top_count")
        )
    else:
        stats = spark.createDataFrame([], "column_name string, nunique bigint, top_count bigint")
    names = spark.createDataFrame(
        [(c, i, bool(re.search(ID_NAME_PATTERN, c)), types[c] == "string") for i, c in enumerate(df.columns)],
        "column_name string, ordinal int, name_hit boolean, is_text boolean",
    )
    j = names.join(F.broadcast(stats), "column_name", "left").crossJoin(F.broadcast(n))
    by_values = (
        F.col("is_text") & (F.coalesce(F.col("nunique"), F.lit(0)) > 1) & (F.col("nunique") < F.col("__n"))
        & (F.col("top_count") / F.col("__n") < top_share)
    )
    return j.select("column_name", (F.col("name_hit") | F.coalesce(by_values, F.lit(False))).alias("is_id_like"))


# ------------------------------------------------------------------ P8
def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame(
        [(f"Missing required column: {c}",) for c in missing], "problem string"
    )


def clean_profile_input(df: DataFrame) -> DataFrame:
    """Helper used by tests: text columns stripped and null tokens removed."""
    return df.select(*[clean_text(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
