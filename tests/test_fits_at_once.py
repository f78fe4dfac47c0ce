"""Independent fits of a query run at once and give their rows in the old order."""

import threading

import pytest
from pyspark.sql import functions as F

from upkeep.operators import train as T
from upkeep.plans import catalog

catalog.load()  # the bindings that the queries name

from upkeep.plans import q_train as Q  # noqa: E402


@pytest.mark.parametrize("query, names, column, values", [
    ("ablation_imbalance", ["random_forest", "random_forest", "xgboost", "xgboost"], "class_weighting", [True, False, True, False]),
    ("ablation_groups", ["random_forest"] * 3, "feature_group", ["raw", "temporal", "raw+temporal"]),
    ("ablation_split", ["xgboost"] * 2, "validation_strategy", ["stratified", "holdout"]),
    ("train_all", T.CANDIDATES, "model", T.CANDIDATES)])
def test_fits_wait_for_each_other(spark, monkeypatch, query, names, column, values):
    met = threading.Barrier(len(names), timeout=60)  # broken if a fit begins after another has ended

    def model(spark, d, name, weighted=True, split="stratified", groups=None):
        met.wait()
        return name

    def metrics(p, models):
        rows = [(n, i, *[0.5] * 6) for i, n in enumerate(models)]
        return spark.createDataFrame(rows, "model string, candidate_order int, accuracy double, precision double, recall double, f1 double, roc_auc double, pr_auc double")

    data = spark.range(4).select(F.lit("test").alias("split"), (F.col("id") % 2).alias("label"))
    monkeypatch.setattr(Q, "prepared", lambda *a, **k: T.Prepared(data, [], {}, {}, {}))
    monkeypatch.setattr(Q, "model", model)
    monkeypatch.setattr(Q.T, "test_metrics", metrics)
    rows = getattr(Q, query)(spark, "nowhere").collect()
    if query == "train_all":
        assert {r["model"] for r in rows} == set(names)
    else:
        assert [(r["model"], r[column]) for r in rows] == list(zip(names, values, strict=True))


def test_boosted_fit_is_the_same_without_stored_node_ids(spark, monkeypatch):
    rows = spark.range(300).select(
        F.lit("train").alias("split"), F.lit(1.0).alias("weight"), (F.col("id") * 37 % 101).cast("double").alias("f0"),
        (F.col("id") * 53 % 97).cast("double").alias("f1"), ((F.col("id") * 37 % 101 + F.col("id") * 53 % 97) % 3 == 0).cast("int").alias("label"))
    prep = T.Prepared(rows, ["f0", "f1"], {}, {}, {})
    found = []
    for engine in (T.BOOSTED_ENGINE, T.TREE_ENGINE):
        monkeypatch.setattr(T, "BOOSTED_ENGINE", engine)
        found.append(T.fit(prep, "xgboost", overrides={"maxIter": 4}).stages[-1].toDebugString.split("\n", 1)[1])
    assert found[0] == found[1]
