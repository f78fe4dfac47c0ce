"""Training data preparation and Spark ML fits.

Preparation is one DataFrame (``split``, ``label``, feature columns) built
from the label, split and feature operators; fitted parameters (thresholds,
category lists, reference date, feature list) travel in a small metadata
dict. Models are Spark ML estimators (distributed ``treeAggregate`` fits);
class weights are a column computed by one aggregation.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.operators import features as X
from upkeep.operators import forest as R
from upkeep.operators import labels as L
from upkeep.operators import metrics as E
from upkeep.operators import splits as D
from upkeep.schema import HIGH, TRAINING_FEATURE_GROUPS
from upkeep.session import cut_lineage

SEED = 42
# FIXED VALUES — model hyper-parameters of the candidates (seed 42)
LOGREG = {"max_iter": 1000}
TREE = {"max_depth": 30}  # unlimited depth → Spark's maximum
FOREST = {"num_trees": 300, "max_depth": 30, "min_instances": 1, "feature_subset": "sqrt"}
BOOSTED = {"num_trees": 300, "max_depth": 6, "step": 0.1, "subsample": 0.8, "colsample": "0.8"}
SEARCH_SPACE = {
    "maxIter": (100, 800),
    "maxDepth": (3, 12),
    "stepSize": (0.01, 0.3),
    "subsamplingRate": (0.5, 1.0),
    "featureSubsetStrategy": (0.5, 1.0),
    "minInstancesPerNode": (1, 10),
}
# Execution settings for deep trees (no effect on the fitted model): more
# nodes split per pass over the data and cached node ids between passes.
TREE_ENGINE = {"maxMemoryInMB": 256, "cacheNodeIds": True, "checkpointInterval": 10}
# The trees of boosting are shallow: walking them costs less than storing node ids at every level.
BOOSTED_ENGINE = {**TREE_ENGINE, "cacheNodeIds": False}
# Each pass of a tree fit builds the statistics of all its nodes once per
# partition, so rows go into few partitions: small ones up to FIT_PARTITIONS of
# them, then larger ones, up to LARGE_PARTITION rows (a row of the forest holds
# two numbers a tree).
SMALL_PARTITION, FIT_PARTITIONS, LARGE_PARTITION = 1 << 14, 16, 1 << 17
# Spark ML holds all nodes of a forest on the driver: up to so many training rows.
# Beyond, tasks grow, keep and apply the trees (``forest``).
DRIVER_FOREST = SMALL_PARTITION
CANDIDATES = ["logistic_regression", "decision_tree", "random_forest", "xgboost"]


@dataclass
class Prepared:
    data: DataFrame                   # key, split, label, weight, features…
    feature_columns: list[str]
    thresholds: dict[str, float]
    categories: dict[str, list[str]]
    weights: dict[str, float]
    meta: dict = field(default_factory=dict)

    def part(self, name: str) -> DataFrame:
        return self.data.where(F.col("split") == name)


# ------------------------------------------------------------------ T5
def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n/(2·n_c) per class and ``scale_pos_weight`` = n0/n1."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("n0"),
               F.count_if(F.col(label) == 1).alias("n1"))
    return n.select(
        (F.col("n") / (2.0 * F.col("n0"))).alias("weight_0"),
        (F.col("n") / (2.0 * F.col("n1"))).alias("weight_1"),
        F.try_divide(F.col("n0").cast("double"), F.col("n1").cast("double")).alias("scale_pos_weight"),
    )


def with_weights(df: DataFrame, train: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    w = class_weights(train, label)
    return df.crossJoin(F.broadcast(w)).withColumn(
        out, F.when(F.col(label) == 1, F.col("weight_1")).otherwise(F.col("weight_0"))
    ).drop("weight_0", "weight_1", "scale_pos_weight")


# ------------------------------------------------------------------ T6
def prepare_training(df: DataFrame, groups: list[str] | None = None, split: str = "stratified",
                     key: str = "machine_id", fit_range: str = "full") -> Prepared:
    """signal gate → score → provisional stratum → split → thresholds on train
    scores → label (High = 1) → features − leakage columns → one-hot fitted on
    train → NULL → 0. ``fit_range="train"`` scores everything with the train
    range (the leakage-free option)."""
    groups = groups or TRAINING_FEATURE_GROUPS
    # several small fit passes read the input: materialise it once in the shared checkpoint folder
    df = cut_lineage(df)
    weights = L.resolve_weights(df)
    if not weights:
        raise ValueError("no populated, varying compliance metric or numeric operational column: "
                         "intervention-priority classification is not supported for this dataset")
    scored = L.priority_score(df, weights)
    prov = D.provisional_label(scored)
    if split == "stratified":
        parted = D.split_stratified(prov, "provisional", key)
    elif split == "holdout":
        parted = D.split_holdout(prov, key)
    else:
        raise ValueError(f"unknown split {split}")
    parted = parted.persist(StorageLevel.MEMORY_AND_DISK)
    train_rows = parted.where(F.col("split") == "train")
    train_params = L.score_params(train_rows, weights)
    train_scored = L.priority_score(train_rows.drop("priority_score"), weights, train_params)
    th = L.fit_thresholds(train_scored).first().asDict()
    if fit_range == "train":
        parted = L.priority_score(parted.drop("priority_score"), weights, train_params)
    labeled = parted.withColumn(
        "label", (L.priority_level(F.col("priority_score"), th["watch_threshold"], th["high_threshold"]) == HIGH)
        .cast("int"))
    cats = X.fit_categories(labeled.where(F.col("split") == "train"))
    drop = list(weights) + X.RATIO_COLUMNS
    ref = X.reference_date(df)
    ref_value = ref.first()[0]
    mat = X.feature_matrix(labeled, cats, groups, drop, keep=[key, "split", "label"], ref=ref)
    feats = [c for c in mat.columns if c not in (key, "split", "label")]
    # the fits iterate over this frame: cut the lineage so each pass is a plain scan
    data = cut_lineage(with_weights(mat, mat.where(F.col("split") == "train")))
    parted.unpersist()
    return Prepared(data, feats, th, cats, weights,
                    {"reference_date": str(ref_value), "groups": groups, "split": split, "key": key})


# ------------------------------------------------------------------ T1-T4
def estimator(name: str, weighted: bool = True, overrides: dict | None = None, n_train: float | None = None):
    w = {"weightCol": "weight"} if weighted else {}
    o = overrides or {}
    if name == "logistic_regression":
        # sklearn C=1 on Σ w·loss ≡ Spark's mean loss with regParam = 1/Σw
        reg = 1.0 / n_train if n_train else 0.0
        return LogisticRegression(maxIter=o.get("maxIter", LOGREG["max_iter"]), regParam=reg, elasticNetParam=0.0,
                                  standardization=False, **w)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=o.get("maxDepth", TREE["max_depth"]), seed=SEED, **TREE_ENGINE, **w)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=o.get("numTrees", FOREST["num_trees"]),
                                      maxDepth=o.get("maxDepth", FOREST["max_depth"]),
                                      featureSubsetStrategy=FOREST["feature_subset"], seed=SEED,
                                      minInstancesPerNode=FOREST["min_instances"], **TREE_ENGINE, **w)
    if name == "xgboost":
        return GBTClassifier(maxIter=o.get("maxIter", BOOSTED["num_trees"]), maxDepth=o.get("maxDepth", BOOSTED["max_depth"]),
                             stepSize=o.get("stepSize", BOOSTED["step"]),
                             subsamplingRate=o.get("subsamplingRate", BOOSTED["subsample"]),
                             featureSubsetStrategy=str(o.get("featureSubsetStrategy", BOOSTED["colsample"])),
                             minInstancesPerNode=int(o.get("minInstancesPerNode", 1)), seed=SEED, **BOOSTED_ENGINE, **w)
    raise ValueError(f"unknown model {name}")


def fit_partitions(n_rows: int) -> int:
    return max(1, min(-(-n_rows // SMALL_PARTITION), FIT_PARTITIONS), -(-n_rows // LARGE_PARTITION))


def dealt(train: DataFrame) -> DataFrame:
    """The rows of a fit, dealt and ordered by their values: bootstrap samples
    depend on both, and so not on the session's shuffle partitions."""
    return train.repartition(fit_partitions(train.count()), *train.columns).sortWithinPartitions(*train.columns)


def fit(prep: Prepared, name: str, weighted: bool = True, overrides: dict | None = None,
        train: DataFrame | None = None) -> PipelineModel | R.Forest:
    train = dealt(prep.part("train") if train is None else train).persist(StorageLevel.MEMORY_AND_DISK)
    if name == "random_forest" and train.count() > DRIVER_FOREST:
        o = overrides or {}
        try:
            return R.grow(train, prep.feature_columns, o.get("numTrees", FOREST["num_trees"]), o.get("maxDepth", FOREST["max_depth"]),
                          math.ceil(math.sqrt(len(prep.feature_columns))), FOREST["min_instances"], SEED, weighted)
        finally:
            train.unpersist()
    n_w = train.agg(F.sum("weight")).first()[0] if name == "logistic_regression" and weighted else (
        train.count() if name == "logistic_regression" else None)
    asm = VectorAssembler(inputCols=prep.feature_columns, outputCol="features", handleInvalid="keep")
    est = estimator(name, weighted, overrides, n_w).setLabelCol("label").setFeaturesCol("features")
    try:
        return Pipeline(stages=[asm, est]).fit(train)
    finally:
        train.unpersist()


def probabilities(model: PipelineModel | R.Forest, df: DataFrame, keep: list[str]) -> DataFrame:
    if isinstance(model, R.Forest):
        return model.probabilities(df, keep)
    # Spark ML sends the whole model with every task
    out = model.transform(df.repartition(fit_partitions(df.count())))
    return out.select(*keep, vector_to_array("probability")[1].alias("p"))


def test_metrics(prep: Prepared, models: dict[str, PipelineModel | R.Forest], part: str = "test") -> DataFrame:
    """E1-E4 per model on one split (predictions at 0.5)."""
    rows = None
    for i, (name, m) in enumerate(models.items()):
        p = probabilities(m, prep.part(part), ["label"]).select(
            F.lit(name).alias("model"), F.lit(i).alias("candidate_order"), F.col("label").alias("y"), "p")
        p = cut_lineage(p)  # the metrics pass over the scores more than once
        rows = p if rows is None else rows.unionByName(p)
    return E.evaluate(rows, ["model", "candidate_order"], "y", "p")


def train_all(prep: Prepared, names: list[str] | None = None) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit every candidate on the same prepared data; test metrics."""
    names = names or CANDIDATES
    models = {n: fit(prep, n) for n in names}
    return models, test_metrics(prep, models)


# ------------------------------------------------------------------ T8
def search_boosted(prep: Prepared, n_trials: int = 50, seed: int = SEED, parallelism: int = 4) -> DataFrame:
    """Random search over the boosted-tree space, scored by validation PR-AUC
    (the test split is never used); fits run as concurrent Spark jobs."""
    from concurrent.futures import ThreadPoolExecutor

    rng = random.Random(seed)
    trials = []
    for _ in range(n_trials):
        t = {}
        for k, (lo, hi) in SEARCH_SPACE.items():
            t[k] = rng.randint(lo, hi) if isinstance(lo, int) and isinstance(hi, int) else round(rng.uniform(lo, hi), 4)
        trials.append(t)

    def run(i_t):
        i, t = i_t
        m = fit(prep, "xgboost", overrides=t)
        met = test_metrics(prep, {f"trial_{i}": m}, part="val").select("pr_auc", "recall").first()
        return (i, json.dumps(t, sort_keys=True), met["pr_auc"], met["recall"])

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        results = list(ex.map(run, enumerate(trials)))
    spark = prep.data.sparkSession
    return spark.createDataFrame(results, "trial int, params string, val_pr_auc double, val_recall double")


# ------------------------------------------------------------------ T12
def save_model(model: PipelineModel | R.Forest, prep: Prepared, path: str, version: str, metrics: dict | None = None) -> str:
    """Pipeline + metadata (feature list, thresholds, categories, reference date)."""
    forest = isinstance(model, R.Forest)
    if forest:
        model.save(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    meta = {"kind": "forest" if forest else "pipeline", "version": version, "feature_columns": prep.feature_columns, "watch_threshold": prep.thresholds["watch_threshold"],
            "high_threshold": prep.thresholds["high_threshold"], "categories": prep.categories,
            "weights": prep.weights, "metrics": metrics or {}, **prep.meta}
    spark = prep.data.sparkSession
    spark.createDataFrame([(json.dumps(meta, default=str),)], "metadata string").write.mode("overwrite").text(f"{path}/metadata")
    return path


def load_model(spark, path: str) -> tuple[PipelineModel | R.Forest, dict]:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if meta.get("kind") == "forest":
        return R.Forest.load(spark, f"{path}/model"), meta
    return PipelineModel.load(f"{path}/model"), meta
