"""Queries for alerts, registries, exports (A), peer view (G) and scoring /
attribution (I) over the serving tables derived from the snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from upkeep.functions.columns import clean_text, r6, r6d
from upkeep.operators import attribution as ATT
from upkeep.operators import metrics as E
from upkeep.operators import peer as G
from upkeep.operators import score as I
from upkeep.operators import serving as A
from upkeep.plans import sqlfrag as S
from upkeep.plans.bindings import processed_export, standard_export
from upkeep.plans.oracle import with_ctes
from upkeep.plans.q_model import _CAND_CTES, candidate_metrics
from upkeep.plans.registry import query
from upkeep.plans.serving_data import (
    LINEAR_MODELS,
    PRIMARY,
    alerts,
    explanations,
    machines,
    model_versions,
    predictions,
    scored,
)
from upkeep.schema import FIELD_DICTIONARY, HIGH, PEER_FIELDS, PEER_NUMERIC, WATCH
from upkeep.session import cut_lineage
from upkeep.sources.testdata import asset_snapshot


# ------------------------------------------------------------------ A1 / A2 / A3
@query("alert_filter", with_ctes(["predictions"], "SELECT id, machine_id, intervention_priority FROM predictions "
                                                  "WHERE intervention_priority IN ('Watch', 'High Priority')"))
def alert_filter(spark, d):
    return A.alert_filter(predictions(spark, d)).select("id", "machine_id", "intervention_priority")


@query("alert_messages", with_ctes(["alerts"], "SELECT id, message FROM alerts"))
def alert_messages(spark, d):
    return alerts(spark, d).select("id", "message")


@query("prediction_tables", with_ctes(["alerts"], """
SELECT 'predictions' AS table_name, count(*) AS n_rows FROM predictions
UNION ALL SELECT 'prediction_explanations', count(*) FROM explanations
UNION ALL SELECT 'alerts', count(*) FROM alerts"""))
def prediction_tables(spark, d):
    parts = [("predictions", predictions(spark, d)), ("prediction_explanations", explanations(spark, d)),
             ("alerts", alerts(spark, d))]
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


# ------------------------------------------------------------------ A4
@query("machine_upsert", with_ctes(["machines", "predictions"], """
SELECT id, machine_identifier, dataset_id FROM machines WHERE dataset_id IN ('cmms_low', 'cmms_medium')
UNION ALL
SELECT DISTINCT p.machine_id, 'M-' || CAST(p.machine_id AS VARCHAR), CAST(NULL AS VARCHAR) FROM predictions p
WHERE p.machine_id NOT IN (SELECT id FROM machines WHERE dataset_id IN ('cmms_low', 'cmms_medium'))"""))
def machine_upsert(spark, d):
    existing = machines(spark, d).where(F.col("dataset_id").isin("cmms_low", "cmms_medium")).select(
        "id", "machine_identifier", "dataset_id")
    incoming = predictions(spark, d).select(
        F.col("machine_id").alias("id"),
        F.concat(F.lit("M-"), F.col("machine_id").cast("string")).alias("machine_identifier"))
    return A.upsert_missing(existing, incoming, "id").select("id", "machine_identifier", "dataset_id")


# ------------------------------------------------------------------ A5
@query("machine_registry", with_ctes(["standard_export"], f"""
SELECT {S.clean_text('machine_id')} AS machine_id,
       arg_min({S.clean_text('equipment_category')}, machine_id)
         FILTER (WHERE {S.clean_text('equipment_category')} IS NOT NULL) AS equipment_category
FROM standard_export WHERE {S.clean_text('machine_id')} IS NOT NULL GROUP BY 1"""))
def machine_registry(spark, d):
    s = standard_export(spark, d).select(
        clean_text("machine_id").alias("key"), clean_text("equipment_category").alias("cat"),
        F.col("machine_id").alias("raw_order"))
    reg = A.first_non_null(s.where(F.col("key").isNotNull()), "key", "cat", "raw_order", "equipment_category")
    return reg.withColumnRenamed("key", "machine_id")


# ------------------------------------------------------------------ A6
@query("dataset_registry", with_ctes(["processed_export"], f"""
SELECT 'cmms_' || lower(criticality) AS name, count(*) AS row_count, CAST({len(FIELD_DICTIONARY) + 4} AS BIGINT) AS column_count,
       count(DISTINCT machine_id) AS machine_count, CAST(min(last_completed_pm) AS DATE) AS start_date,
       CAST(max(last_completed_pm) AS DATE) AS end_date, 'Processed' AS status
FROM processed_export GROUP BY 1"""))
def dataset_registry(spark, d):
    p = processed_export(spark, d)
    ncols = len(p.columns)
    return p.groupBy(F.concat(F.lit("cmms_"), F.lower("criticality")).alias("name")).agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(ncols).cast("bigint").alias("column_count"),
        F.count_distinct("machine_id").alias("machine_count"),
        F.to_date(F.min("last_completed_pm")).alias("start_date"), F.to_date(F.max("last_completed_pm")).alias("end_date"),
        F.lit("Processed").alias("status"))


# ------------------------------------------------------------------ A7 / A8
_ACT = ("act", "SELECT * EXCLUDE (active), row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC NULLS LAST, "
               "id DESC) = 1 AS active FROM model_versions")


def _activated(spark, d):
    return A.activate_latest(model_versions(spark, d))


@query("activate_version", with_ctes(["model_versions"], "SELECT id, dataset_id, active FROM act", [_ACT]))
def activate_version(spark, d):
    return _activated(spark, d).select("id", "dataset_id", "active")


@query("active_model", with_ctes(["model_versions"], "SELECT dataset_id, arg_max(id, (created_at, id)) AS model_version_id "
                                                     "FROM act WHERE active GROUP BY dataset_id", [_ACT]))
def active_model(spark, d):
    return A.active_model(_activated(spark, d))


# ------------------------------------------------------------------ A9
def _runs(metrics):
    return metrics.select(
        F.concat(F.lit("exp:"), F.col("model")).alias("experiment_id"), F.lit("asset_snapshot").alias("dataset"),
        "model", F.lit("raw").alias("feature_group"), F.lit("none").alias("validation_strategy"),
        r6(F.col("pr_auc")).alias("pr_auc"), r6(F.col("recall")).alias("recall"), "candidate_order")


@query("experiment_runs", with_ctes(["candidates"], """
SELECT 'exp:' || model AS experiment_id, 'asset_snapshot' AS dataset, model, 'raw' AS feature_group,
       'none' AS validation_strategy, round(pr_auc, 6) AS pr_auc, round(recall, 6) AS recall FROM met""", _CAND_CTES))
def experiment_runs(spark, d):
    runs = _runs(candidate_metrics(spark, d))
    stored = runs.where(F.col("candidate_order") < 2)
    new = runs.where(F.col("candidate_order") >= 2)
    return A.append_unique(stored, new, "experiment_id").drop("candidate_order")


# ------------------------------------------------------------------ A10
_DEL = "cmms_low"


@query("cascade_delete", with_ctes(["alerts", "machines", "model_versions"], f"""
SELECT 'machines' AS table_name, count_if(dataset_id = '{_DEL}') AS n_deleted, count_if(dataset_id <> '{_DEL}') AS n_remaining
FROM machines
UNION ALL SELECT 'model_versions', count_if(dataset_id = '{_DEL}'), count_if(dataset_id <> '{_DEL}') FROM model_versions
UNION ALL SELECT 'predictions', count_if(gone), count_if(NOT gone) FROM pgone
UNION ALL SELECT 'alerts', count_if(g), count_if(NOT g) FROM (
  SELECT a.id, coalesce(a.prediction_id IN (SELECT id FROM pgone WHERE gone), FALSE)
           OR coalesce(a.machine_id IN (SELECT id FROM machines WHERE dataset_id = '{_DEL}'), FALSE) AS g FROM alerts a)
UNION ALL SELECT 'prediction_explanations', count_if(g), count_if(NOT g) FROM (
  SELECT e.prediction_id IN (SELECT id FROM pgone WHERE gone) AS g FROM explanations e)""",
    [("pgone", f"SELECT id, (machine_id IN (SELECT id FROM machines WHERE dataset_id = '{_DEL}')) OR "
               f"(model_version_id IN (SELECT id FROM model_versions WHERE dataset_id = '{_DEL}')) AS gone "
               f"FROM predictions")]))
def cascade_delete(spark, d):
    # stored tables, as in the registry: each is built once, not again in every task that joins it
    res = A.cascade_delete(_DEL, *[cut_lineage(t(spark, d)) for t in (machines, model_versions, predictions, explanations, alerts)])
    out = None
    for name, (gone, kept) in res.items():
        row = gone.agg(F.count(F.lit(1)).alias("n_deleted")).crossJoin(kept.agg(F.count(F.lit(1)).alias("n_remaining")))
        row = row.select(F.lit(name).alias("table_name"), "n_deleted", "n_remaining")
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------------ A11-A14
_MJ = "JOIN machines m ON m.id = {t}.machine_id"


@query("export_equipment_health", with_ctes(["predictions", "machines"], f"""
SELECT m.machine_identifier AS machine, p.prediction_timestamp AS "timestamp", p.failure_probability AS probability,
       p.intervention_priority FROM predictions p {_MJ.format(t='p')}"""))
def export_equipment_health(spark, d):
    return A.export_equipment_health(predictions(spark, d), machines(spark, d))


@query("export_predictions", with_ctes(["predictions", "machines"], f"""
SELECT p.id AS prediction_id, m.machine_identifier AS machine, p.prediction_timestamp, p.failure_probability,
       p.predicted_class, p.intervention_priority, p.model_version_id, p.created_at FROM predictions p {_MJ.format(t='p')}"""))
def export_predictions(spark, d):
    return A.export_predictions(predictions(spark, d), machines(spark, d))


@query("export_alerts", with_ctes(["alerts", "machines"], f"""
SELECT a.id AS alert_id, m.machine_identifier AS machine, a.created_at AS "timestamp", a.intervention_priority, a.status,
       a.message FROM alerts a {_MJ.format(t='a')}"""))
def export_alerts(spark, d):
    return A.export_alerts(alerts(spark, d), machines(spark, d))


@query("export_active_models", with_ctes(["model_versions"], """
SELECT id AS model_version_id, version, model_type, dataset_id, threshold, created_at, active FROM act WHERE active""",
                                         [_ACT]))
def export_active_models(spark, d):
    return A.export_active_models(_activated(spark, d))


# ------------------------------------------------------------------ A15 / A16
@query("overview_kpis", with_ctes(["machines", "alerts", "predictions"], """
SELECT (SELECT count(*) FROM machines) AS machine_count,
       (SELECT count_if(status = 'New') FROM alerts) AS active_alerts,
       (SELECT count(*) FROM predictions) AS prediction_count,
       (SELECT count(DISTINCT machine_id) FILTER (WHERE intervention_priority = 'High Priority') FROM predictions)
         AS high_priority_machines"""))
def overview_kpis(spark, d):
    return A.overview_kpis(machines(spark, d), alerts(spark, d), predictions(spark, d))


def _changes(al):
    new = al.where(F.col("status") == "New")
    ack = new.where(F.col("machine_id") % 3 != 2).select(
        F.col("id").alias("alert_id"), F.lit("Acknowledged").alias("new_status"),
        F.timestamp_add("DAY", F.lit(3), F.col("created_at")).alias("changed_at"))
    close = new.where(F.col("machine_id") % 3 == 1).select(
        F.col("id").alias("alert_id"), F.lit("Closed").alias("new_status"),
        F.timestamp_add("DAY", F.lit(5), F.col("created_at")).alias("changed_at"))
    return ack.unionByName(close)


@query("alert_status_update", with_ctes(["alerts"], """
SELECT a.id, coalesce(c.new_status, a.status) AS status,
  CASE WHEN c.new_status IN ('Acknowledged', 'Reviewed') AND a.acknowledged_at IS NULL THEN c.changed_at
       ELSE a.acknowledged_at END AS acknowledged_at,
  CASE WHEN c.new_status = 'Closed' THEN c.changed_at ELSE a.closed_at END AS closed_at
FROM alerts a LEFT JOIN (SELECT alert_id, arg_max(new_status, (changed_at, new_status)) AS new_status,
                                max(changed_at) AS changed_at FROM ch GROUP BY alert_id) c ON c.alert_id = a.id""",
    [("ch", "SELECT id AS alert_id, 'Acknowledged' AS new_status, created_at + INTERVAL 3 DAY AS changed_at FROM alerts "
            "WHERE status = 'New' AND machine_id % 3 <> 2 UNION ALL SELECT id, 'Closed', created_at + INTERVAL 5 DAY "
            "FROM alerts WHERE status = 'New' AND machine_id % 3 = 1")]))
def alert_status_update(spark, d):
    al = cut_lineage(alerts(spark, d))  # a stored table: built once, not again for each kind of change
    return A.apply_status_changes(al, _changes(al)).select("id", "status", "acknowledged_at", "closed_at")


# ------------------------------------------------------------------ A17
@query("high_priority_ranking", with_ctes(["predictions", "machines"], f"""
SELECT m.machine_identifier AS machine, p.prediction_timestamp AS "timestamp", p.failure_probability AS probability,
       p.intervention_priority FROM predictions p {_MJ.format(t='p')} WHERE p.intervention_priority = 'High Priority'
ORDER BY probability DESC, machine"""))
def high_priority_ranking(spark, d):
    return A.high_priority_ranking(predictions(spark, d), machines(spark, d))


@query("priority_trend", with_ctes(["predictions"], """
SELECT date_trunc('month', prediction_timestamp) AS period, intervention_priority, count(*) AS n_predictions,
       round(avg(failure_probability), 6) AS mean_probability FROM predictions GROUP BY 1, 2"""))
def priority_trend(spark, d):
    return A.priority_trend(predictions(spark, d))


@query("alerts_by_status", with_ctes(["alerts"], f"""
SELECT status, count_if(intervention_priority = '{WATCH}') AS "{WATCH}",
       count_if(intervention_priority = '{HIGH}') AS "{HIGH}" FROM alerts GROUP BY status"""))
def alerts_by_status(spark, d):
    return A.alerts_by_status(alerts(spark, d), ["New", "Acknowledged", "Reviewed", "Closed"], [WATCH, HIGH])


_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


@query("model_metric_pivot", with_ctes(["candidates"], " UNION ALL ".join(
    f"SELECT '{m}' AS metric, " + ", ".join(
        f"round(max({m}) FILTER (WHERE model = '{n}'), 6) AS {n}" for n in LINEAR_MODELS) + " FROM met"
    for m in _METRICS), _CAND_CTES))
def model_metric_pivot(spark, d):
    met = candidate_metrics(spark, d)
    long = met.select("model", *[r6(F.col(m)).alias(m) for m in _METRICS]).unpivot(["model"], _METRICS, "metric", "value")
    return long.groupBy("metric").pivot("model", list(LINEAR_MODELS)).agg(F.max("value"))


# ------------------------------------------------------------------ A18
@query("list_machines", with_ctes(["machines"], "SELECT DISTINCT machine_identifier FROM machines ORDER BY 1"))
def list_machines(spark, d):
    return A.list_sorted(machines(spark, d), "machine_identifier")


# ------------------------------------------------------------------ G1 / G2
@query("has_peer_data", with_ctes(["standard_export"], "SELECT (" + " + ".join(
    f"CASE WHEN count({c}) > 0 THEN 1 ELSE 0 END" for c in PEER_FIELDS) + ") > 0 AS has_peer_data, "
    "CAST(" + " + ".join(f"CASE WHEN count({c}) > 0 THEN 1 ELSE 0 END" for c in PEER_FIELDS)
    + " AS BIGINT) AS n_fields_populated FROM standard_export"))
def has_peer_data(spark, d):
    return G.has_peer_data(standard_export(spark, d))


@query("peer_view", with_ctes(["standard_export"], "SELECT machine_id, " + ", ".join(
    (f"{c}" if c in PEER_NUMERIC else c) for c in PEER_FIELDS) + " FROM standard_export"))
def peer_view(spark, d):
    return G.peer_view(standard_export(spark, d))


# ------------------------------------------------------------------ I1 / I3 / I4 / I5 / I6
_TRAINED = ["total_completed_pms", "total_cost", "extra__shift_utilization_hours", "extra__spare_parts_count"]


@query("align_features", with_ctes(["processed_export"], """
SELECT machine_id, coalesce(CAST(total_completed_pms AS DOUBLE), 0.0) AS total_completed_pms,
       coalesce(CAST(total_cost AS DOUBLE), 0.0) AS total_cost, 0.0 AS extra__shift_utilization_hours,
       coalesce(extra__spare_parts_count, 0.0) AS extra__spare_parts_count FROM processed_export"""))
def align_features(spark, d):
    return I.align_features(processed_export(spark, d), _TRAINED, keep=["machine_id"])


@query("score_linear", with_ctes(["scored"], "SELECT machine_id, probability FROM scored"))
def score_linear(spark, d):
    b, w = LINEAR_MODELS[PRIMARY]
    return I.score_linear(asset_snapshot(spark, d), w, b).select("machine_id", "probability")


@query("attribution_linear", with_ctes(["explanations"], "SELECT prediction_id, feature_name, feature_value, "
                                       f"{S.r6d('shap_value')} AS shap_value, importance_rank FROM explanations"))
def attribution_linear(spark, d):
    e = explanations(spark, d)
    return e.select("prediction_id", "feature_name", "feature_value", r6d(F.col("shap_value")).alias("shap_value"),
                    "importance_rank")


def _all_attr_sql() -> str:
    _b, w = LINEAR_MODELS[PRIMARY]
    z = lambda c: f"coalesce(CAST({c} AS DOUBLE), 0.0)"
    mu = ", ".join(f"avg({z(c)}) AS mu_{c}" for c in w)
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature_name, CAST({k!r} AS DOUBLE) * ({z(c)} - mu_{c}) AS shap_value FROM asset_snapshot, mu"
        for c, k in w.items())
    return with_ctes(["asset_snapshot"], f"SELECT feature_name, {S.r6d('avg(abs(shap_value))')} AS mean_abs_shap "
                     f"FROM ({rows}) GROUP BY feature_name",
                     [("mu", f"SELECT {mu} FROM (SELECT * FROM asset_snapshot ORDER BY "
                             f"md5('42:' || CAST(machine_id AS VARCHAR)), machine_id LIMIT 100)")])


@query("global_importance", _all_attr_sql())
def global_importance(spark, d):
    snap = asset_snapshot(spark, d)
    _b, w = LINEAR_MODELS[PRIMARY]
    att = ATT.linear_attributions(snap, "machine_id", w, I.background_sample(snap, "machine_id"), top_k=None)
    g = ATT.global_importance(att)
    return g.select("feature_name", r6d(F.col("mean_abs_shap")).alias("mean_abs_shap"))


@query("background_sample", with_ctes(["asset_snapshot"], "SELECT machine_id FROM asset_snapshot ORDER BY "
                                      "md5('42:' || CAST(machine_id AS VARCHAR)), machine_id LIMIT 100"))
def background_sample(spark, d):
    return I.background_sample(asset_snapshot(spark, d), "machine_id").select("machine_id")


_unused = (E, scored)
