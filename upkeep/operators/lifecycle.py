"""Whole steps of the product, each one commit of all tables it changes: import a
dataset, train and activate, score and save, delete a dataset.

All take a ``TableSet`` with ``SERVING_TABLES``. New ids continue the table's
largest one in a fixed order of the rows (``positions.global_position``), so a
step that is repeated after a failure gives the same ids.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions.columns import clean_text
from upkeep.operators import features as X
from upkeep.operators import metrics as E
from upkeep.operators import score as I
from upkeep.operators import serving as A
from upkeep.operators import train as T
from upkeep.operators.attribution import TOP_K, tree_attributions
from upkeep.operators.clean import preprocess
from upkeep.operators.mapping import apply_mapping, drop_null_key, suggest_mapping, type_extras
from upkeep.operators.positions import global_position
from upkeep.session import cut_lineage
from upkeep.sources.tables import Commit, TableSet

ALERT_NEW = "New"


def _numbered(rows: DataFrame, order: list[str], stored: DataFrame, out: str = "id") -> DataFrame:
    """Ids after the stored table's largest."""
    last = stored.agg(F.max("id")).first()[0] or 0
    return global_position(rows, order, out=out).withColumn(out, F.col(out) + F.lit(int(last)))


def get_or_create_machines(change: Commit, identifiers: DataFrame, about: list[str] | None = None) -> DataFrame:
    """(id, machine_identifier) of all stored machines and those of ``identifiers`` that
    are not stored yet, which are staged with their ``about`` columns."""
    stored = change.read("machines")
    new = (identifiers.where(F.col("machine_identifier").isNotNull()).dropDuplicates(["machine_identifier"])
           .join(stored.select("machine_identifier"), "machine_identifier", "left_anti").select("machine_identifier", *(about or [])))
    new = cut_lineage(_numbered(new, ["machine_identifier"], stored))
    return stored.select("id", "machine_identifier").unionByName(change.append("machines", new).select("id", "machine_identifier"))


# ------------------------------------------------------------------ import
def import_dataset(tables: TableSet, raw: DataFrame, name: str, source_filename: str, override: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Map, clean and register a raw export in one commit. The mapping is ``override``,
    else the one saved for the dataset, else the suggested one; it is saved. A
    machine's category is its first real one, taken before missing values are
    filled. Returns the processed rows and the mapping."""
    saved = {r["field"]: r["column_name"] for r in tables.read("mappings").where(F.col("dataset") == name).collect()}
    mapping = override or saved or suggest_mapping(raw.columns)
    standard = drop_null_key(type_extras(apply_mapping(raw, mapping, source_filename)))
    processed = cut_lineage(preprocess(standard, persist=False)[0])
    category = A.first_non_null(standard.select(clean_text("machine_id").alias("machine_identifier"), clean_text("equipment_category").alias("c"),
                                                F.col("machine_id").alias("o")), "machine_identifier", "c", "o", "equipment_category")
    with tables.commit(f"import:{name}:{tables.manifest()['version']}") as change:
        spark = tables.spark
        n = processed.agg(F.count("*").alias("n"), F.count_distinct("machine_id").alias("m")).first()
        row = [(name, source_filename, n["n"], len(processed.columns), n["m"], "Processed")]
        change.replace("datasets", change.read("datasets").where(F.col("name") != name).unionByName(
            spark.createDataFrame(row, tables.schemas["datasets"])))
        own = spark.createDataFrame([(name, f, c) for f, c in mapping.items() if c is not None], tables.schemas["mappings"])
        change.replace("mappings", change.read("mappings").where(F.col("dataset") != name).unionByName(own))
        found = processed.select(F.col("machine_id").alias("machine_identifier")).distinct().join(category, "machine_identifier", "left")
        get_or_create_machines(change, found.withColumn("dataset_id", F.lit(name)), ["equipment_category", "dataset_id"])
    return processed, mapping


# ------------------------------------------------------------------ train
def train_and_activate(tables: TableSet, prep: T.Prepared, dataset: str, version: str, path: str, at: Column,
                       names: list[str] | None = None) -> tuple[str, DataFrame]:
    """Fit every candidate, save it, record a run for each and register the best by
    average precision (then recall) as the dataset's only active version, in one
    commit. A version that the dataset has already is refused. Returns the chosen
    name and the metrics."""
    runs = tables.read("experiment_runs")
    names = names or T.CANDIDATES
    ids = [f"{dataset}_{n}_{version}" for n in names]
    if runs.where(F.col("experiment_id").isin(ids)).limit(1).count():
        raise ValueError(f"version {version} of {dataset} exists")
    models, metrics = T.train_all(prep, names)
    metrics = cut_lineage(metrics)
    chosen = E.select_model(metrics).first()["selected_model"]
    values = {r["model"]: {k: r[k] for k in metrics.columns if k not in ("model", "candidate_order")} for r in metrics.collect()}  # a row per candidate
    for n, m in models.items():
        T.save_model(m, prep, f"{path}/{dataset}_{n}_{version}", version, values[n])
    with tables.commit(f"train:{dataset}:{version}") as change:
        if change is not None:
            spark = tables.spark
            rows = [(i, dataset, n, "+".join(prep.meta.get("groups", [])), prep.meta.get("split"), json.dumps({"version": version}), json.dumps(values[n]))
                    for i, n in zip(ids, names, strict=True)]
            new = spark.createDataFrame(rows, "experiment_id string, dataset string, model string, feature_group string, validation_strategy string, "
                                              "parameters_json string, metrics_json string")
            change.append("experiment_runs", new.withColumn("run_timestamp", at))
            others = change.read("model_versions").withColumn("active", F.col("active") & ~F.col("dataset_id").eqNullSafe(F.lit(dataset)))
            own = spark.createDataFrame([(f"{dataset}:{chosen}:{version}", version, chosen, chosen, dataset, 0.5, json.dumps(values[chosen]), True)],
                                        "id string, version string, model_name string, model_type string, dataset_id string, threshold double, "
                                        "metrics_json string, active boolean").withColumn("created_at", at)
            change.replace("model_versions", others.unionByName(own.select(others.columns)))
    return chosen, metrics


# ------------------------------------------------------------------ score
def save_scores(tables: TableSet, key: str, scored: DataFrame, explanations: DataFrame | None = None) -> bool:
    """Store scored rows in one commit: machines get or create, predictions, up to
    ``TOP_K`` explanations each, and alerts for the alertable ones. ``scored`` has
    row (unique), machine_identifier, failure_probability, predicted_class,
    intervention_priority, model_version_id and prediction_timestamp;
    ``explanations`` has row, feature_name, feature_value, shap_value and
    importance_rank. Rows without a machine are refused. Returns False, with
    nothing stored, if ``key`` was committed before."""
    scored = cut_lineage(scored)
    if scored.where(F.col("machine_identifier").isNull()).limit(1).count():
        raise ValueError("a scored row has no machine")
    with tables.commit(key) as change:
        if change is None:
            return False
        machines = get_or_create_machines(change, scored.select("machine_identifier"))
        rows = scored.join(machines.withColumnRenamed("id", "machine_id"), "machine_identifier")
        rows = cut_lineage(_numbered(rows, ["machine_identifier", "row"], change.read("predictions")))
        change.append("predictions", rows)
        top = None
        if explanations is not None:
            own = explanations.where(F.col("importance_rank") <= TOP_K).join(rows.select("row", F.col("id").alias("prediction_id")), "row")
            written = change.append("prediction_explanations", own)
            top = written.where("importance_rank = 1").select("prediction_id", F.col("feature_name").alias("top"))
        alerts = A.alert_filter(rows).withColumnRenamed("id", "prediction_id")
        alerts = alerts.join(top, "prediction_id", "left") if top is not None else alerts.withColumn("top", F.lit(None).cast("string"))
        message = A.alert_message(F.col("machine_identifier"), F.col("intervention_priority"), F.col("failure_probability"), F.col("model_version_id"), F.col("top"))
        alerts = alerts.select("prediction_id", "machine_id", "intervention_priority", message.alias("message"), F.lit(ALERT_NEW).alias("status"),
                               F.col("prediction_timestamp").alias("created_at"))
        change.append("alerts", _numbered(alerts, ["prediction_id"], change.read("alerts")))
    return True


def score_and_save(tables: TableSet, key: str, df: DataFrame, model, meta: dict, model_version_id: str, at: Column,
                   background: DataFrame | None = None) -> bool:
    """Score rows with a fitted pipeline and its saved metadata, explain them (tree
    models, if a background is given) and store everything in one commit. Recency is
    measured from the training reference date, not from the scored rows."""
    problems = I.check_input(df)
    if problems:
        raise ValueError(f"Invalid inference input: {problems}")
    feats = meta["feature_columns"]

    def matrix(rows: DataFrame, keep: list[str]) -> DataFrame:
        ref = rows.sparkSession.range(1).select(F.lit(meta["reference_date"]).cast("timestamp_ntz").alias("__ref"))
        built = X.feature_matrix(rows, meta["categories"], meta["groups"], list(meta["weights"]) + X.RATIO_COLUMNS, keep=keep, ref=ref)
        return I.align_features(built, feats, keep=keep)

    numbered = cut_lineage(df.withColumn("row", F.monotonically_increasing_id()))
    aligned = cut_lineage(matrix(numbered, ["row", "machine_id"]))
    scored = I.classify(T.probabilities(model, aligned, ["row", "machine_id"]).withColumnRenamed("p", "failure_probability"), "failure_probability",
                        meta["watch_threshold"], meta["high_threshold"])
    scored = scored.select("row", F.col("machine_id").cast("string").alias("machine_identifier"), "failure_probability", "predicted_class",
                           "intervention_priority", F.lit(model_version_id).alias("model_version_id"), at.alias("prediction_timestamp"))
    found = None
    if background is not None:
        found = tree_attributions(aligned, "row", feats, model.stages[-1], matrix(background, ["machine_id"]), TOP_K)
    return save_scores(tables, key, scored, found)


# ------------------------------------------------------------------ delete
def delete_dataset(tables: TableSet, dataset: str) -> dict[str, int]:
    """Remove a dataset and all that depends on it in one commit: machines, model
    versions, predictions of either, their explanations and alerts, experiment
    runs, the saved mapping. An unknown dataset is refused. Returns the number of
    rows removed from each table."""
    known = [tables.read("datasets").where(F.col("name") == dataset), tables.read("machines").where(F.col("dataset_id") == dataset),
             tables.read("model_versions").where(F.col("dataset_id") == dataset)]
    if not any(k.limit(1).count() for k in known):
        raise ValueError(f"No dataset named {dataset!r} found.")
    removed = {}
    with tables.commit(f"delete:{dataset}:{tables.manifest()['version']}") as change:
        five = A.cascade_delete(dataset, *(change.read(n) for n in ("machines", "model_versions", "predictions", "prediction_explanations", "alerts")))
        left = {name: kept for name, (_gone, kept) in five.items()}
        for name, column in (("datasets", "name"), ("mappings", "dataset"), ("experiment_runs", "dataset")):
            left[name] = change.read(name).where(~F.col(column).eqNullSafe(F.lit(dataset)))
        for name, kept in left.items():
            removed[name] = change.read(name).count() - change.replace(name, kept).count()
    return removed
