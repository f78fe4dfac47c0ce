"""Commits of several tables, and the whole steps built on them."""

import pytest
from pyspark.sql import functions as F

from upkeep.operators import lifecycle as L
from upkeep.operators import train as T
from upkeep.plans.bindings import processed_export
from upkeep.schema import SERVING_TABLES
from upkeep.sources.files import scratch_path
from upkeep.sources.tables import Conflict, TableSet
from upkeep.sources.testdata import raw_export

SF = "/root/testdata/sf0.001"


def at():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


@pytest.fixture
def tables(spark):
    return TableSet(spark, scratch_path(spark, "t"), SERVING_TABLES)


def named(spark, *names):
    return spark.createDataFrame([(n, None) for n in names], "name string, status string")


def test_commit_is_all_or_nothing(spark, tables):
    with tables.commit("one") as c:
        c.append("datasets", named(spark, "a"))
    with pytest.raises(RuntimeError, match="killed"), tables.commit("two") as c:
        c.append("datasets", named(spark, "b"))
        c.replace("mappings", spark.createDataFrame([("b", "f", "c")], SERVING_TABLES["mappings"]))
        raise RuntimeError("killed between two writes")
    assert [r["name"] for r in tables.read("datasets").collect()] == ["a"] and tables.read("mappings").count() == 0
    assert tables.manifest()["version"] == 1
    with tables.commit("two") as c:  # the repeated job
        c.append("datasets", named(spark, "b"))
    with tables.commit("two") as c:
        assert c is None
    assert sorted(r["name"] for r in tables.read("datasets").collect()) == ["a", "b"]
    tables.compact("datasets")
    assert len(tables.manifest()["tables"]["datasets"]) == 1 and tables.read("datasets").count() == 2


def test_of_two_commits_at_once_the_second_is_refused(spark, tables):
    with pytest.raises(Conflict), tables.commit("slow") as slow:
        slow.append("datasets", named(spark, "slow"))
        with tables.commit("fast") as fast:
            fast.append("datasets", named(spark, "fast"))
    assert [r["name"] for r in tables.read("datasets").collect()] == ["fast"]


def test_missing_columns_are_refused(spark, tables):
    with pytest.raises(ValueError, match="mappings: missing columns field"), tables.commit("x") as c:
        c.append("mappings", spark.createDataFrame([("d",)], "dataset string"))
    assert tables.manifest()["version"] == 0


def scores(spark, rows):
    return spark.createDataFrame(rows, "row long, machine_identifier string, failure_probability double, intervention_priority string").select(
        "*", (F.col("failure_probability") >= 0.5).cast("int").alias("predicted_class"), F.lit("v1").alias("model_version_id"), at().alias("prediction_timestamp"))


def test_save_scores_twice_and_again(spark, tables):
    first = scores(spark, [(1, "m2", 0.9, "High Priority"), (2, "m1", 0.1, "Normal"), (3, "m2", 0.6, "Watch")])
    why = spark.createDataFrame([(1, f"f{k}", 1.0, 0.5, k) for k in range(1, 8)], "row long, feature_name string, feature_value double, shap_value double, importance_rank int")
    assert L.save_scores(tables, "a", first, why) and not L.save_scores(tables, "a", first, why)
    assert L.save_scores(tables, "b", scores(spark, [(1, "m3", 0.7, "Watch"), (2, "m1", 0.2, "Normal")]))
    assert {(r["id"], r["machine_identifier"]) for r in tables.read("machines").collect()} == {(1, "m1"), (2, "m2"), (3, "m3")}
    assert {(r["id"], r["machine_id"]) for r in tables.read("predictions").collect()} == {(1, 1), (2, 2), (3, 2), (4, 1), (5, 3)}
    assert sorted((r["prediction_id"], r["importance_rank"]) for r in tables.read("prediction_explanations").collect()) == [(2, k) for k in range(1, 6)]
    alerts = {r["prediction_id"]: r for r in tables.read("alerts").collect()}
    assert sorted(alerts) == [2, 3, 5] and sorted(a["id"] for a in alerts.values()) == [1, 2, 3] and {a["status"] for a in alerts.values()} == {"New"}
    assert alerts[2]["message"] == "Machine m2 classified as High Priority (failure probability 0.90, model v1). Top contributing factor: f1."
    assert alerts[5]["message"] == "Machine m3 classified as Watch (failure probability 0.70, model v1)."
    with pytest.raises(ValueError, match="no machine"):
        L.save_scores(tables, "c", scores(spark, [(1, None, 0.1, "Normal")]))


def test_import_saves_the_mapping_and_first_real_categories(spark, tables):
    raw = raw_export(spark, SF)
    processed, mapping = L.import_dataset(tables, raw, "plant", "export.csv")
    assert mapping["machine_id"] == "Asset ID"
    row = tables.read("datasets").collect()
    assert [(r["name"], r["row_count"], r["status"]) for r in row] == [("plant", processed.count(), "Processed")]
    machines = tables.read("machines").collect()
    assert len(machines) == row[0]["machine_count"] and {m["dataset_id"] for m in machines} == {"plant"}
    assert "Unknown" not in {m["equipment_category"] for m in machines}
    override = {**mapping, "manufacturer": "Irrelevant Notes"}
    L.import_dataset(tables, raw, "plant", "export.csv", override)  # the override wins and is saved
    again, used = L.import_dataset(tables, raw, "plant", "export.csv")
    assert used["manufacturer"] == "Irrelevant Notes" and tables.read("datasets").count() == 1 and tables.read("machines").count() == len(machines)


def test_train_score_and_delete(spark, tables):
    rows = processed_export(spark, SF)
    prep = T.prepare_training(rows)
    path = scratch_path(spark, "models")
    chosen, _ = L.train_and_activate(tables, prep, "plant", "1", path, at(), ["logistic_regression", "decision_tree"])
    with pytest.raises(ValueError, match="version 1"):
        L.train_and_activate(tables, prep, "plant", "1", path, at(), ["decision_tree"])
    L.train_and_activate(tables, prep, "plant", "2", path, at(), ["decision_tree"])
    active = {r["version"]: r["active"] for r in tables.read("model_versions").collect()}
    assert active == {"1": False, "2": True} and tables.read("experiment_runs").count() == 3 and chosen in ("logistic_regression", "decision_tree")
    model, meta = T.load_model(spark, f"{path}/plant_decision_tree_2")
    late = rows.limit(20).withColumn("last_completed_pm", F.lit("2031-01-01 00:00:00").cast("timestamp_ntz"))
    assert L.score_and_save(tables, "s", late, model, meta, "plant:decision_tree:2", at(), background=rows.limit(10))
    assert tables.read("predictions").count() == 20 and tables.read("prediction_explanations").count() == 100
    since = tables.read("prediction_explanations").where("feature_name = 'days_since_last_completed_pm'").collect()
    assert all(r["feature_value"] < 0 for r in since)  # later than the training reference date, which stays
    with pytest.raises(ValueError, match="machine_id"):
        L.score_and_save(tables, "t", late.drop("machine_id"), model, meta, "v", at())
    with pytest.raises(ValueError, match="No dataset"):
        L.delete_dataset(tables, "other")
    gone = L.delete_dataset(tables, "plant")  # no machine is the dataset's: its predictions go by their version alone
    assert gone["model_versions"] == 2 and gone["predictions"] == 20 and gone["prediction_explanations"] == 100 and gone["experiment_runs"] == 3
    assert tables.read("machines").count() == tables.read("machines").where("dataset_id IS NULL").count() > 0
