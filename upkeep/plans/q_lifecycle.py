"""Queries of the whole steps: score and save, and delete a dataset, each as one
commit into a fresh set of tables, read back by content."""

from __future__ import annotations

from pyspark.sql import functions as F

from upkeep.functions.columns import r6
from upkeep.operators import lifecycle as L
from upkeep.operators import serving as A
from upkeep.plans.oracle import with_ctes
from upkeep.plans.registry import query
from upkeep.plans.serving_data import explanations, machines, model_versions, predictions
from upkeep.schema import SERVING_TABLES
from upkeep.sources.files import scratch_path
from upkeep.sources.tables import TableSet

KNOWN = ("cmms_low", "cmms_medium")
GONE = "cmms_low"


def _seeded(spark, d) -> TableSet:
    """Tables that hold the machines of two datasets and all model versions."""
    tables = TableSet(spark, scratch_path(spark, "serving"), SERVING_TABLES)
    with tables.commit("seed") as change:
        change.append("machines", machines(spark, d).where(F.col("dataset_id").isin(*KNOWN)))
        change.append("model_versions", A.activate_latest(model_versions(spark, d)))
    return tables


def _scored(spark, d, version):
    machine = F.concat(F.lit("M-"), F.col("machine_id").cast("string"))
    return predictions(spark, d).select(F.col("id").alias("row"), machine.alias("machine_identifier"), "failure_probability", "predicted_class",
                                        "intervention_priority", version.alias("model_version_id"), "prediction_timestamp")


def _contents(tables: TableSet, names: list[str]):
    """(table_name, item, detail, value) of the live rows; ids by what they refer to."""
    who = tables.read("machines").select(F.col("id").alias("machine_id"), "machine_identifier")
    preds = tables.read("predictions").join(who, "machine_id")
    row_of = preds.select(F.col("id").alias("prediction_id"), "machine_identifier")
    nothing = F.lit(None).cast("double")
    parts = {
        "machines": tables.read("machines").select(F.col("machine_identifier").alias("item"), F.coalesce("dataset_id", F.lit("")).alias("detail"), nothing.alias("value")),
        "model_versions": tables.read("model_versions").select(F.col("id").alias("item"), F.col("active").cast("string").alias("detail"), nothing.alias("value")),
        "predictions": preds.select(F.col("machine_identifier").alias("item"), F.concat_ws(" ", "intervention_priority", "predicted_class", "model_version_id").alias("detail"),
                                    F.col("failure_probability").alias("value")),
        "prediction_explanations": tables.read("prediction_explanations").join(row_of, "prediction_id").select(
            F.concat_ws(":", "machine_identifier", "importance_rank").alias("item"), F.col("feature_name").alias("detail"), r6(F.col("shap_value")).alias("value")),
        "alerts": tables.read("alerts").join(row_of, "prediction_id").select(F.col("machine_identifier").alias("item"), F.col("message").alias("detail"), nothing.alias("value")),
    }
    out = None
    for n in names:
        part = parts[n].select(F.lit(n).alias("table_name"), "item", "detail", "value")
        out = part if out is None else out.unionByName(part)
    return out


_EXPLAINED = """'M-' || CAST(e.prediction_id AS VARCHAR) || ':' || CAST(e.importance_rank AS VARCHAR) AS item, e.feature_name AS detail,
       round(e.shap_value, 6) AS value FROM explanations e"""


@query("score_and_save", with_ctes(["machines", "alerts"], f"""
SELECT 'machines' AS table_name, machine_identifier AS item, CASE WHEN dataset_id IN {KNOWN} THEN dataset_id ELSE '' END AS detail,
       CAST(NULL AS DOUBLE) AS value FROM machines
UNION ALL SELECT 'predictions', 'M-' || CAST(machine_id AS VARCHAR), intervention_priority || ' ' || CAST(predicted_class AS VARCHAR) || ' ' ||
       model_version_id, failure_probability FROM predictions
UNION ALL SELECT 'prediction_explanations', {_EXPLAINED}
UNION ALL SELECT 'alerts', 'M-' || CAST(machine_id AS VARCHAR), message, NULL FROM alerts"""))
def score_and_save(spark, d):
    """Half of the machines are known before; the job runs twice and adds its rows once."""
    tables = _seeded(spark, d)
    for _ in range(2):
        L.save_scores(tables, "scores", _scored(spark, d, F.col("model_version_id")), explanations(spark, d).withColumnRenamed("prediction_id", "row"))
    return _contents(tables, ["machines", "predictions", "prediction_explanations", "alerts"])


# every tenth machine was scored by a version of the deleted dataset, so some
# predictions go for their version alone and some for their machine alone
_VERSION = f"CASE WHEN machine_id % 10 = 0 THEN '{GONE}:linear_a' ELSE model_version_id END"
_LEFT = ("kept", f"""SELECT p.machine_id, p.failure_probability, p.predicted_class, p.intervention_priority, {_VERSION.replace('machine_id %', 'p.machine_id %')} AS version
FROM predictions p JOIN machines m ON m.id = p.machine_id
WHERE NOT (m.dataset_id = '{GONE}' AND m.dataset_id IN {KNOWN}) AND p.machine_id % 10 <> 0""")


@query("delete_dataset", with_ctes(["machines", "model_versions", "explanations", "predictions"], f"""
SELECT 'machines' AS table_name, machine_identifier AS item, CASE WHEN dataset_id IN {KNOWN} THEN dataset_id ELSE '' END AS detail,
       CAST(NULL AS DOUBLE) AS value FROM machines WHERE dataset_id <> '{GONE}'
UNION ALL SELECT 'model_versions', id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1 AS VARCHAR), NULL
  FROM model_versions WHERE dataset_id <> '{GONE}'
UNION ALL SELECT 'predictions', 'M-' || CAST(machine_id AS VARCHAR), intervention_priority || ' ' || CAST(predicted_class AS VARCHAR) || ' ' || version,
       failure_probability FROM kept
UNION ALL SELECT 'prediction_explanations', {_EXPLAINED} WHERE e.prediction_id IN (SELECT machine_id FROM kept)""", [_LEFT]))
def delete_dataset(spark, d):
    """What is left after one of three datasets is deleted with its dependents."""
    tables = _seeded(spark, d)
    L.save_scores(tables, "scores", _scored(spark, d, F.expr(_VERSION)), explanations(spark, d).withColumnRenamed("prediction_id", "row"))
    L.delete_dataset(tables, GONE)
    return _contents(tables, ["machines", "model_versions", "predictions", "prediction_explanations"])
