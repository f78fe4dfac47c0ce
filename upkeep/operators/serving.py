"""Alerts, registries, lifecycle and BI exports.

Stored tables are parquet DataFrames with deterministic keys; every "write"
is a set operation (anti join + union, latest-wins join) instead of per-row
inserts, so the same code runs for ten rows or ten billion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.schema import ALERTABLE_LEVELS, HIGH


# ------------------------------------------------------------------ A1 / A2
def alert_filter(predictions: DataFrame, priority_col: str = "intervention_priority") -> DataFrame:
    return predictions.where(F.col(priority_col).isin(*ALERTABLE_LEVELS))


def probability_text(p) -> F.Column:
    """Two decimals, half-even on the 6-decimal value (exact decimal arithmetic)."""
    return F.bround(p.cast("decimal(18,6)"), 2).cast("string")


def alert_message(machine, priority, probability, version, top_factor=None) -> F.Column:
    base = F.concat(
        F.lit("Machine "), machine.cast("string"), F.lit(" classified as "), priority,
        F.lit(" (failure probability "), probability_text(probability), F.lit(", model "), version, F.lit(")."),
    )
    if top_factor is None:
        return base
    return F.when(top_factor.isNull(), base).otherwise(
        F.concat(base, F.lit(" Top contributing factor: "), top_factor, F.lit(".")))


# ------------------------------------------------------------------ A4 / A5 / A6
def upsert_missing(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert keys not yet stored, once (anti join + union); stored rows untouched."""
    new = incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)


def first_non_null(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """Per key the value of the earliest row (by ``order``) whose value is not NULL."""
    return df.groupBy(key).agg(
        F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias(out))


# ------------------------------------------------------------------ A7 / A8 / A9
def activate_latest(versions: DataFrame, dataset_col: str = "dataset_id", time_col: str = "created_at",
                    key: str = "id") -> DataFrame:
    """Exactly one active version per dataset: the newest (ties by key)."""
    w = Window.partitionBy(dataset_col).orderBy(F.col(time_col).desc_nulls_last(), F.col(key).desc())
    return versions.withColumn("active", F.row_number().over(w) == 1)


def active_model(versions: DataFrame, dataset_col: str = "dataset_id") -> DataFrame:
    """Newest active version per dataset (``max_by`` over a struct)."""
    act = versions.where(F.col("active"))
    return act.groupBy(dataset_col).agg(F.max_by(F.col("id"), F.struct("created_at", "id")).alias("model_version_id"))


def append_unique(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append ``rows``; a key that already exists fails the job. The check is
    part of the same plan: a semi join reduced to a one-row (count, smallest
    key) guard, cross-joined onto the appended rows, raises on a duplicate."""
    dup = rows.join(table.select(key), key, "left_semi").agg(
        F.count(F.lit(1)).alias("__dups"), F.min(key).cast("string").alias("__dup"))
    fail = F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col("__dup")))
    guarded = rows.crossJoin(F.broadcast(dup)).where(F.when(F.col("__dups") > 0, fail).otherwise(F.lit(True)))
    return table.unionByName(guarded.drop("__dups", "__dup"))


# ------------------------------------------------------------------ A10
def cascade_delete(dataset_id: str, machines: DataFrame, versions: DataFrame, predictions: DataFrame,
                   explanations: DataFrame, alerts: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Remove a dataset and its dependents: machines and versions of the
    dataset, predictions of those machines *or* versions, their explanations
    and alerts. Returns ``{table: (deleted, remaining)}``."""
    m_del = machines.where(F.col("dataset_id") == dataset_id)
    v_del = versions.where(F.col("dataset_id") == dataset_id)
    p_del = predictions.join(m_del.select(F.col("id").alias("machine_id")), "machine_id", "left_semi").unionByName(
        predictions.join(v_del.select(F.col("id").alias("model_version_id")), "model_version_id", "left_semi")
    ).dropDuplicates(["id"])
    e_del = explanations.join(p_del.select(F.col("id").alias("prediction_id")), "prediction_id", "left_semi")
    a_del = alerts.join(p_del.select(F.col("id").alias("prediction_id")), "prediction_id", "left_semi").unionByName(
        alerts.join(m_del.select(F.col("id").alias("machine_id")), "machine_id", "left_semi")).dropDuplicates(["id"])
    out = {}
    for name, full, gone, key in [
        ("machines", machines, m_del, "id"), ("model_versions", versions, v_del, "id"),
        ("predictions", predictions, p_del, "id"), ("alerts", alerts, a_del, "id"),
    ]:
        out[name] = (gone, full.join(gone.select(key), key, "left_anti"))
    keep_e = explanations.join(p_del.select(F.col("id").alias("prediction_id")), "prediction_id", "left_anti")
    out["prediction_explanations"] = (e_del, keep_e)
    return out


# ------------------------------------------------------------------ A11-A14
def export_equipment_health(predictions: DataFrame, machines: DataFrame) -> DataFrame:
    m = machines.select(F.col("id").alias("machine_id"), F.col("machine_identifier").alias("machine"))
    return predictions.join(m, "machine_id").select(
        "machine", F.col("prediction_timestamp").alias("timestamp"), F.col("failure_probability").alias("probability"),
        "intervention_priority")


def export_predictions(predictions: DataFrame, machines: DataFrame) -> DataFrame:
    m = machines.select(F.col("id").alias("machine_id"), F.col("machine_identifier").alias("machine"))
    return predictions.join(m, "machine_id").select(
        F.col("id").alias("prediction_id"), "machine", "prediction_timestamp", "failure_probability",
        "predicted_class", "intervention_priority", "model_version_id", "created_at")


def export_alerts(alerts: DataFrame, machines: DataFrame) -> DataFrame:
    m = machines.select(F.col("id").alias("machine_id"), F.col("machine_identifier").alias("machine"))
    return alerts.join(m, "machine_id").select(
        F.col("id").alias("alert_id"), "machine", F.col("created_at").alias("timestamp"), "intervention_priority",
        "status", "message")


def export_active_models(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("active")).select(
        F.col("id").alias("model_version_id"), "version", "model_type", "dataset_id", "threshold", "created_at",
        "active")


# ------------------------------------------------------------------ A15 / A16
def overview_kpis(machines: DataFrame, alerts: DataFrame, predictions: DataFrame) -> DataFrame:
    m = machines.agg(F.count(F.lit(1)).alias("machine_count"))
    a = alerts.agg(F.count_if(F.col("status") == "New").alias("active_alerts"))
    p = predictions.agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.count_distinct(F.when(F.col("intervention_priority") == HIGH, F.col("machine_id"))).alias("high_priority_machines"),
    )
    return m.crossJoin(a).crossJoin(p)


def apply_status_changes(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change per alert wins; Acknowledged/Reviewed stamp
    ``acknowledged_at`` (if unset), Closed stamps ``closed_at``."""
    latest = changes.groupBy("alert_id").agg(
        F.max_by(F.struct("new_status", "changed_at"), F.struct("changed_at", "new_status")).alias("c"))
    j = alerts.join(latest.select(F.col("alert_id").alias("id"), "c"), "id", "left")
    st = F.col("c.new_status")
    return j.select(
        *[c for c in alerts.columns if c not in ("status", "acknowledged_at", "closed_at")],
        F.coalesce(st, F.col("status")).alias("status"),
        F.when(st.isin("Acknowledged", "Reviewed") & F.col("acknowledged_at").isNull(), F.col("c.changed_at"))
        .otherwise(F.col("acknowledged_at")).alias("acknowledged_at"),
        F.when(st == "Closed", F.col("c.changed_at")).otherwise(F.col("closed_at")).alias("closed_at"),
    )


# ------------------------------------------------------------------ A17 / A18
def high_priority_ranking(predictions: DataFrame, machines: DataFrame) -> DataFrame:
    hp = export_equipment_health(predictions.where(F.col("intervention_priority") == HIGH), machines)
    return hp.orderBy(F.col("probability").desc(), F.col("machine"))


def priority_trend(predictions: DataFrame, period: str = "month") -> DataFrame:
    return predictions.groupBy(
        F.date_trunc(period, F.col("prediction_timestamp")).cast("timestamp_ntz").alias("period"),
        "intervention_priority",
    ).agg(F.count(F.lit(1)).alias("n_predictions"), F.round(F.avg("failure_probability"), 6).alias("mean_probability"))


def alerts_by_status(alerts: DataFrame, statuses: list[str], priorities: list[str]) -> DataFrame:
    """Status × priority counts with a fixed pivot column list (no pivot-value scan)."""
    return alerts.groupBy("status").pivot("intervention_priority", priorities).agg(F.count(F.lit(1))).na.fill(0)


def list_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)
