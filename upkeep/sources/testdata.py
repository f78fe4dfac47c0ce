"""Bindings of the standard shapes to the driver's parquet tables.

* ``asset_snapshot`` — one row per customer, compliance counts from orders.
* ``telemetry`` — one row per event.
* ``raw_export`` — the snapshot as a dirty all-string source export
  (blanks, null tokens, a text sentinel, mixed date formats, duplicates).

Every binding reads whole tables; filters and projections are written so that
Catalyst pushes them into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cond_count(cond) -> F.Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def asset_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    )
    open_ = F.col("o_orderstatus") == "O"
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    per_cust = orders.groupBy("o_custkey").agg(
        _cond_count(open_ & urgent).alias("overdue_pms"),
        _cond_count(open_ & ~urgent).alias("overdue_wos"),
        _cond_count(F.col("o_orderstatus") == "F").alias("total_completed_pms"),
        _cond_count(F.col("o_orderstatus") == "P").alias("total_completed_wos"),
        F.sum(F.when(open_, F.floor(F.col("o_totalprice") / 1000).cast("bigint")).otherwise(0))
        .cast("double")
        .alias("downtime_minutes"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_completed_pm"),
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))).alias("last_completed_wo"),
    )
    snap = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
    return snap.select(
        F.col("c_custkey").alias("machine_id"),
        F.col("c_mktsegment").alias("equipment_category"),
        F.when(F.col("c_nationkey") % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("MFR_"), F.col("c_nationkey").cast("string")))
        .alias("manufacturer"),
        F.when(F.col("c_acctbal") >= 7000, "High")
        .when(F.col("c_acctbal") >= 3000, "Medium")
        .otherwise("Low")
        .alias("criticality"),
        "overdue_pms",
        "overdue_wos",
        "total_completed_pms",
        "total_completed_wos",
        "downtime_minutes",
        F.col("c_acctbal").alias("total_cost"),
        "last_completed_pm",
        "last_completed_wo",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.col("user_id").alias("machine_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("vibration"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
        .otherwise(F.col("value") * 0.5)
        .alias("pressure"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("failure_label"),
    )


RAW_EXPORT_COLUMNS = [
    "Asset ID",
    "Equipment Category",
    "Manufacturer",
    "Criticality",
    "Overdue PMs",
    "Overdue WOs",
    "Total Completed PMs",
    "Total Completed WOs",
    "Downtime (min)",
    "Total Cost",
    "Last Completed PM",
    "Last Completed WO",
    "Global Anomaly Score",
    "Serial Number",
    "Spare Parts Count",
    "Irrelevant Notes",
]


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string export, dirtied deterministically by key ``k``."""
    s = asset_snapshot(spark, sf_dir)
    k = F.col("machine_id")
    ks = k.cast("string")
    txt = lambda c: F.col(c).cast("string")
    rows = s.select(
        k.alias("_k"),
        F.when(k % 3 == 0, F.concat(F.lit("  "), ks, F.lit(" ")))
        .when(k % 3 == 1, F.concat(F.lit("\t"), ks))
        .otherwise(ks)
        .alias("Asset ID"),
        F.when(k % 13 == 0, F.lit("")).otherwise(F.col("equipment_category")).alias("Equipment Category"),
        F.when(k % 7 == 1, F.lit(""))
        .when(k % 7 == 2, F.lit("None"))
        .when(k % 7 == 3, F.lit("nan"))
        .when(k % 5 == 4, F.concat(F.col("manufacturer"), F.lit(" ")))
        .otherwise(F.col("manufacturer"))
        .alias("Manufacturer"),
        F.col("criticality").alias("Criticality"),
        txt("overdue_pms").alias("Overdue PMs"),
        F.when(k % 17 == 0, F.lit("5d")).otherwise(txt("overdue_wos")).alias("Overdue WOs"),
        txt("total_completed_pms").alias("Total Completed PMs"),
        txt("total_completed_wos").alias("Total Completed WOs"),
        F.col("downtime_minutes").cast("bigint").cast("string").alias("Downtime (min)"),
        F.col("total_cost").cast("decimal(12,2)").cast("string").alias("Total Cost"),
        F.when(k % 2 == 0, F.date_format("last_completed_pm", "yyyy/MM/dd"))
        .otherwise(F.date_format("last_completed_pm", "yyyy-MM-dd"))
        .alias("Last Completed PM"),
        F.date_format("last_completed_wo", "yyyy-MM-dd").alias("Last Completed WO"),
        F.when(k % 11 == 0, F.lit("Not Applicable (area node)"))
        .otherwise((k % 97).cast("string"))
        .alias("Global Anomaly Score"),
        F.when(k % 2 == 0, F.concat(F.lit("SN-"), ks)).otherwise(ks).alias("Serial Number"),
        (k % 23).cast("string").alias("Spare Parts Count"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("note "), (k % 4).cast("string")))
        .alias("Irrelevant Notes"),
    )
    copies = rows.where(F.col("_k") % 10 == 0).withColumn(
        "Asset ID",
        F.when(F.col("_k") % 20 == 10, F.concat(F.col("_k").cast("string"), F.lit(" "))).otherwise(F.col("Asset ID")),
    )
    return rows.unionByName(copies).drop("_k")
