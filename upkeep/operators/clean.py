"""Cleaning (C1-C9): text, numeric and date normalisation, duplicates,
missing values, IQR outliers, scaling, and the reportable pipeline."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions.columns import clean_text, parse_mixed, parse_timestamp, strip_ws, to_double
from upkeep.operators.positions import exact_percentiles, fitted_row
from upkeep.operators.profile import missingness
from upkeep.schema import COMPLIANCE_FIELDS, DATE_FIELDS, TEXT_FIELDS, UNKNOWN_LABEL


def clean(df: DataFrame) -> DataFrame:
    """Strip + null tokens for text fields, guarded numeric coercion for
    compliance fields, mixed-format dates (date text stripped once in a
    projection below, then parsed)."""
    types = dict(df.dtypes)
    pre = [strip_ws(F.col(c)).alias(c) if c in DATE_FIELDS and types[c] == "string" else F.col(c) for c in df.columns]
    df = df.select(*pre)
    out = []
    for c in df.columns:
        if c in TEXT_FIELDS:
            out.append(clean_text(c).alias(c) if types[c] == "string" else F.col(c))
        elif c in COMPLIANCE_FIELDS:
            out.append(to_double(F.col(c), types[c]).alias(c))
        elif c in DATE_FIELDS:
            out.append((parse_mixed(F.col(c), stripped=True) if types[c] == "string" else parse_timestamp(F.col(c), types[c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def dedupe(df: DataFrame) -> DataFrame:
    """C4: drop all-column duplicates (nulls equal)."""
    return df.dropDuplicates()


def fill_missing(df: DataFrame, numeric_fill: float = 0.0) -> DataFrame:
    """Numerics → 0.0, text → 'Unknown', never the identifier; dates untouched."""
    nums = {c: numeric_fill for c in COMPLIANCE_FIELDS if c in df.columns}
    texts = {c: UNKNOWN_LABEL for c in TEXT_FIELDS if c in df.columns and c != "machine_id"}
    return df.na.fill(nums).na.fill(texts) if (nums or texts) else df


# ------------------------------------------------------------------ C6 / C7
def iqr_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One-row frame: per column q1/q3 (linear, exact; all columns in one
    distributed pass) and the ±1.5·IQR fences."""
    q = exact_percentiles(df, columns, [0.25, 0.75], [[f"__q1_{c}", f"__q3_{c}"] for c in columns])
    sel = []
    for c in columns:
        q1, q3 = F.col(f"__q1_{c}"), F.col(f"__q3_{c}")
        sel += [(q1 - 1.5 * (q3 - q1)).alias(f"__lo_{c}"), (q3 + 1.5 * (q3 - q1)).alias(f"__hi_{c}")]
    return q.select(*sel)


def iqr_outlier_flags(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Adds ``<col>_outlier`` booleans; NULL never flagged; rows never removed."""
    columns = columns or [c for c in COMPLIANCE_FIELDS if c in df.columns]
    b = fitted_row(iqr_bounds(df, columns))
    j = df.crossJoin(F.broadcast(b))
    for c in columns:
        x = F.col(c)
        j = j.withColumn(f"{c}_outlier", x.isNotNull() & ((x < F.col(f"__lo_{c}")) | (x > F.col(f"__hi_{c}"))))
    return j.drop(*b.columns)


def iqr_outlier_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, n_outliers)``."""
    columns = columns or [c for c in COMPLIANCE_FIELDS if c in df.columns]
    flagged = iqr_outlier_flags(df, columns)
    wide = flagged.agg(*[F.count_if(F.col(f"{c}_outlier")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "n_outliers")


# ------------------------------------------------------------------ C8
def fit_scaler(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """One-row parameter frame (fit on train only). ``standard`` uses the
    population std; zero spread divides by 1."""
    if method not in ("standard", "minmax"):
        raise ValueError(f"Unknown scaling method: {method}")
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        if method == "standard":
            aggs += [F.avg(x).alias(f"__a_{c}"), F.stddev_pop(x).alias(f"__b_{c}")]
        else:
            aggs += [F.min(x).alias(f"__a_{c}"), (F.max(x) - F.min(x)).alias(f"__b_{c}")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    j = df.crossJoin(F.broadcast(params))
    for c in columns:
        spread = F.when(F.col(f"__b_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__b_{c}"))
        j = j.withColumn(c, (F.col(c).cast("double") - F.col(f"__a_{c}")) / spread)
    return j.drop(*params.columns)


# ------------------------------------------------------------------ C9
def preprocess(df: DataFrame, persist: bool = True) -> tuple[DataFrame, DataFrame]:
    """missing-before → clean → dedupe → outlier counts (before fill) → fill →
    missing-after. Returns (filled frame, long report table
    ``(section, item, value)``). The deduplicated frame feeds four
    aggregates, so it is persisted once."""
    before_n = df.agg(F.count(F.lit(1)).alias("v"))
    miss_before = missingness(df)
    cleaned = clean(df)
    deduped = dedupe(cleaned)
    if persist:
        deduped = deduped.persist(StorageLevel.MEMORY_AND_DISK)
    outliers = iqr_outlier_counts(deduped)
    filled = fill_missing(deduped)
    after_n = deduped.agg(F.count(F.lit(1)).alias("v"))
    miss_after = missingness(filled)
    clean_n = cleaned.agg(F.count(F.lit(1)).alias("v"))
    report = (
        before_n.select(F.lit("rows").alias("section"), F.lit("rows_before").alias("item"), F.col("v").cast("double").alias("value"))
        .unionByName(after_n.select(F.lit("rows").alias("section"), F.lit("rows_after").alias("item"), F.col("v").cast("double").alias("value")))
        .unionByName(clean_n.crossJoin(after_n.withColumnRenamed("v", "a")).select(
            F.lit("rows").alias("section"), F.lit("duplicates_dropped").alias("item"),
            (F.col("v") - F.col("a")).cast("double").alias("value")))
        .unionByName(miss_before.select(F.lit("missing_before").alias("section"), F.col("column_name").alias("item"),
                                        F.col("missing_pct").alias("value")))
        .unionByName(miss_after.select(F.lit("missing_after").alias("section"), F.col("column_name").alias("item"),
                                       F.col("missing_pct").alias("value")))
        .unionByName(outliers.select(F.lit("outliers").alias("section"), F.col("column_name").alias("item"),
                                     F.col("n_outliers").cast("double").alias("value")))
    )
    return filled, report
