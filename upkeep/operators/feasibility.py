"""Feasibility analysis (F1-F5): what a dataset supports, from one wide
aggregation pass (plus one distinct-row count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.operators.labels import extra_numeric_columns, signal_aggs
from upkeep.schema import COMPLIANCE_FIELDS, DATE_FIELDS

# FIXED VALUES — limitation codes reported when a task is not supported
LIMITATIONS = {
    "no_failure_label": "No populated failure_label column: failure classification would need a fabricated label.",
    "no_priority_signal": "No populated, varying compliance metrics or numeric operational columns: "
                          "intervention-priority classification is not supported.",
    "single_snapshot": "Single point-in-time snapshot (about one row per machine): time-series and "
                       "failure-horizon prediction are not supported.",
}


def feasibility_metrics(df: DataFrame, dataset: str) -> DataFrame:
    """One row: structure metrics, signal flags, label presence, date ranges."""
    cols = df.columns
    comp = [c for c in COMPLIANCE_FIELDS if c in cols]
    extras = extra_numeric_columns(df)
    dates = [c for c in DATE_FIELDS if c in cols]
    sig = signal_aggs(comp + extras)
    aggs = [
        F.count(F.lit(1)).alias("row_count"),
        (F.count_distinct("machine_id") if "machine_id" in cols else F.lit(0)).cast("bigint").alias("machine_count"),
        (F.count("failure_label") > 0 if "failure_label" in cols else F.lit(False)).alias("has_failure_label"),
    ]
    aggs += sig
    for c in dates:
        aggs += [F.min(F.to_date(c)).alias(f"__min_{c}"), F.max(F.to_date(c)).alias(f"__max_{c}")]
    m = df.agg(*aggs)
    distinct = df.distinct().agg(F.count(F.lit(1)).alias("__distinct"))
    m = m.crossJoin(distinct)
    any_signal = F.lit(False)
    for c in comp + extras:
        any_signal = any_signal | F.col(c)
    mean = F.when(F.col("machine_count") > 0, F.round(F.col("row_count") / F.col("machine_count"), 2)).otherwise(0.0)
    return m.select(
        F.lit(dataset).alias("dataset"),
        "row_count",
        F.lit(len(cols)).cast("bigint").alias("column_count"),
        "machine_count",
        mean.alias("records_per_machine_mean"),
        (F.col("row_count") - F.col("__distinct")).alias("duplicate_row_count"),
        "has_failure_label",
        any_signal.alias("has_priority_signal"),
        *[F.col(f"__min_{c}") for c in dates],
        *[F.col(f"__max_{c}") for c in dates],
    ).withColumn("is_single_snapshot", (F.col("machine_count") > 0) & (F.col("records_per_machine_mean") < 1.5))


def structure(df: DataFrame, dataset: str) -> DataFrame:
    """F1."""
    return feasibility_metrics(df, dataset).select(
        "dataset", "row_count", "column_count", "machine_count", "records_per_machine_mean", "duplicate_row_count"
    )


def date_ranges(df: DataFrame, dataset: str) -> DataFrame:
    """``(dataset, field, min_date, max_date)`` for date fields with values."""
    dates = [c for c in DATE_FIELDS if c in df.columns]
    m = feasibility_metrics(df, dataset)
    if not dates:
        return df.sparkSession.createDataFrame([], "dataset string, field string, min_date date, max_date date")
    rows = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"__min_{c}").alias("min_date"), F.col(f"__max_{c}").alias("max_date"))
        for c in dates
    ])
    return m.select("dataset", F.explode(rows).alias("r")).select("dataset", "r.*").where(F.col("min_date").isNotNull())


def tasks(df: DataFrame, dataset: str) -> DataFrame:
    """``(dataset, kind, item)`` with kind ``task`` or ``limitation``."""
    dates = [c for c in DATE_FIELDS if c in df.columns]
    m = feasibility_metrics(df, dataset)
    has_dates = F.lit(False)
    for c in dates:
        has_dates = has_dates | F.col(f"__min_{c}").isNotNull()
    lab, sig, snap = F.col("has_failure_label"), F.col("has_priority_signal"), F.col("is_single_snapshot")
    machines = F.col("machine_count")

    def item(kind, name, cond):
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("item")))

    items = F.array_compact(F.array(
        item("task", "binary_failure_classification", lab),
        item("limitation", "no_failure_label", ~lab),
        item("task", "intervention_priority_classification", sig & (machines > 0)),
        item("limitation", "no_priority_signal", ~(sig & (machines > 0))),
        item("limitation", "single_snapshot", snap),
        item("task", "time_series_analysis", ~snap & has_dates),
        item("task", "anomaly_detection_across_machines", (machines > 1) & sig),
    ))
    return m.select("dataset", F.explode(items).alias("r")).select("dataset", "r.*")


def report(df: DataFrame, dataset: str) -> DataFrame:
    """long report ``(dataset, section, item, value)``, ordered for display
    (missingness descending)."""
    from upkeep.operators.profile import missingness

    s = structure(df, dataset)
    metrics = ["row_count", "column_count", "machine_count", "records_per_machine_mean", "duplicate_row_count"]
    struct_rows = s.select("dataset", *[F.col(c).cast("string").alias(c) for c in metrics]).unpivot(
        ["dataset"], metrics, "item", "value").withColumn("section", F.lit("structure"))
    dr = date_ranges(df, dataset).select(
        "dataset", F.lit("date_range").alias("section"), F.col("field").alias("item"),
        F.concat_ws(" to ", F.col("min_date").cast("string"), F.col("max_date").cast("string")).alias("value"))
    miss = missingness(df).select(
        F.lit(dataset).alias("dataset"), F.lit("missingness").alias("section"), F.col("column_name").alias("item"),
        F.col("missing_pct").cast("string").alias("value"), F.col("missing_pct").alias("__o"))
    tk = tasks(df, dataset).select("dataset", F.col("kind").alias("section"), "item", F.lit("yes").alias("value"))
    out = (struct_rows.select("dataset", "section", "item", "value", F.lit(None).cast("double").alias("__o"))
           .unionByName(dr.withColumn("__o", F.lit(None).cast("double")))
           .unionByName(miss)
           .unionByName(tk.withColumn("__o", F.lit(None).cast("double"))))
    return out.orderBy("dataset", "section", F.col("__o").desc_nulls_last(), "item").drop("__o")
