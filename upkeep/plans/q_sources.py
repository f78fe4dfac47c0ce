"""Queries for sources and sinks (S): each writes into a fresh folder under
the shared checkpoint folder and scans it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.functions.columns import r6
from upkeep.operators import serving as A
from upkeep.operators.profile import inspect_table
from upkeep.plans.oracle import with_ctes
from upkeep.plans.q_model import _CAND_CTES, candidate_metrics
from upkeep.plans.registry import query
from upkeep.plans.serving_data import machines, predictions
from upkeep.sources import files as FS
from upkeep.sources.testdata import RAW_EXPORT_COLUMNS, asset_snapshot, raw_export


@query("scan_csv", with_ctes(["raw_export"], "SELECT * FROM raw_export"))
def scan_csv(spark, d):
    path = FS.write_csv(raw_export(spark, d), FS.scratch_path(spark, "raw_export_csv"), null_value=FS.NULL_MARKER)
    return FS.read_csv(spark, path, null_value=FS.NULL_MARKER)


@query("inspect_bounded")
def inspect_bounded_q(spark, d):
    raw = raw_export(spark, d)
    return inspect_table(raw, [f"`{c}`" for c in RAW_EXPORT_COLUMNS])


_TYPED = {"Overdue WOs": T.LongType(), "Global Anomaly Score": T.LongType()}


@query("bad_record_report", with_ctes(["raw_export"], """
SELECT count(*) AS n_rows, count_if("Overdue WOs" = '5d' OR "Global Anomaly Score" LIKE 'Not Applicable%') AS n_bad_rows
FROM raw_export"""))
def bad_record_report(spark, d):
    path = FS.write_csv(raw_export(spark, d), FS.scratch_path(spark, "raw_export_csv"))
    problems = FS.validate_source(spark, path)
    if problems:
        raise ValueError(problems)
    schema = T.StructType([T.StructField(c, _TYPED.get(c, T.StringType()), True) for c in RAW_EXPORT_COLUMNS])
    return FS.bad_record_report(spark, path, schema)


@query("trim_empty_columns", with_ctes(["raw_export"], """
SELECT *, CASE WHEN "Spare Parts Count" = '0' THEN 'x' END AS column_16 FROM raw_export"""))
def trim_empty_columns(spark, d):
    raw = raw_export(spark, d)
    padded = raw.select(
        "*", F.when(F.col("`Spare Parts Count`") == "0", F.lit("x")).alias("_c16"),
        F.lit(None).cast("string").alias("_c17"), F.lit(None).cast("string").alias("_c18"))
    return FS.trim_empty_columns(padded)


@query("parquet_roundtrip", with_ctes(["asset_snapshot"], "SELECT * FROM asset_snapshot"))
def parquet_roundtrip(spark, d):
    path = FS.write_processed(asset_snapshot(spark, d), FS.scratch_path(spark, "processed"))
    return FS.load_processed(spark, path)


@query("export_csv", with_ctes(["predictions", "machines"], """
SELECT m.machine_identifier AS machine, p.prediction_timestamp AS "timestamp", p.failure_probability AS probability,
       p.intervention_priority FROM predictions p JOIN machines m ON m.id = p.machine_id"""))
def export_csv(spark, d):
    health = A.export_equipment_health(predictions(spark, d), machines(spark, d))
    path = FS.write_csv(health, FS.scratch_path(spark, "equipment_health"))
    return FS.read_csv(spark, path, health.schema)


_MET = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


@query("metrics_unpivot", with_ctes(["candidates"], " UNION ALL ".join(
    f"SELECT 'asset_snapshot' AS experiment, model, '{m}' AS metric, round({m}, 6) AS value FROM met" for m in _MET),
    _CAND_CTES))
def metrics_unpivot(spark, d):
    met = candidate_metrics(spark, d).select(
        F.lit("asset_snapshot").alias("experiment"), "model", *[r6(F.col(m)).alias(m) for m in _MET])
    path = FS.write_metrics(met, FS.scratch_path(spark, "experiments"))
    return FS.metrics_long(spark, path)
