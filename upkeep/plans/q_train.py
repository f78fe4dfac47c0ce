"""Queries for training (T), model scoring (I3) and tree attributions (I4).

Model fits have no SQL oracle (rows-only check); class weights do. Prepared
data and fitted models are memoised per (session, scale dir) so the queries
of one run share fits instead of refitting the same model.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions.columns import r6
from upkeep.operators import attribution as ATT
from upkeep.operators import labels as L
from upkeep.operators import metrics as E
from upkeep.operators import splits as D
from upkeep.operators import timeseries as W
from upkeep.operators import train as T
from upkeep.operators.score import align_features, background_sample, classify
from upkeep.plans.bindings import processed_export
from upkeep.plans.oracle import with_ctes
from upkeep.plans.registry import query
from upkeep.session import cut_lineage
from upkeep.sources.files import scratch_path
from upkeep.sources.testdata import telemetry

BACKGROUND_ROWS = 100

_MEMO: dict = {}
_METRIC_COLS = ["model", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


def _memo(spark, d, key, build):
    k = (spark.sparkContext.applicationId, d, key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def prepared(spark, d, split="stratified", groups=None):
    g = tuple(groups) if groups else None
    return _memo(spark, d, ("prep", split, g),
                 lambda: T.prepare_training(processed_export(spark, d), list(g) if g else None, split))


def model(spark, d, name, weighted=True, split="stratified", groups=None):
    g = tuple(groups) if groups else None
    return _memo(spark, d, ("model", name, weighted, split, g),
                 lambda: T.fit(prepared(spark, d, split, groups), name, weighted))


def _together(*jobs: Callable) -> list:
    """What independent jobs return, in order. They run at once: a fit is a row of
    thousands of small Spark jobs, which alone leave most cores idle."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def _metrics_rows(df):
    return df.select("model", *[r6(F.col(c)).alias(c) for c in _METRIC_COLS[1:]])


# ------------------------------------------------------------------ T5 (SQL)
@query("class_weights", with_ctes(["labeled"], """
SELECT round(count(*) / (2.0 * count_if(label = 0)), 6) AS weight_0, round(count(*) / (2.0 * count_if(label = 1)), 6)
       AS weight_1, round(CAST(count_if(label = 0) AS DOUBLE) / count_if(label = 1), 6) AS scale_pos_weight
FROM labeled"""))
def class_weights(spark, d):
    from upkeep.plans.serving_data import labeled

    w = T.class_weights(labeled(spark, d))
    return w.select(*[r6(F.col(c)).alias(c) for c in w.columns])


# ------------------------------------------------------------------ T6
@query("prepare_training")
def prepare_training(spark, d):
    return prepared(spark, d).data


# ------------------------------------------------------------------ T1-T4, T7
def _single(spark, d, name):
    p = prepared(spark, d)
    return _metrics_rows(T.test_metrics(p, {name: model(spark, d, name)}))


@query("train_logreg")
def train_logreg(spark, d):
    return _single(spark, d, "logistic_regression")


@query("train_tree")
def train_tree(spark, d):
    return _single(spark, d, "decision_tree")


@query("train_forest")
def train_forest(spark, d):
    return _single(spark, d, "random_forest")


@query("train_gbt")
def train_gbt(spark, d):
    return _single(spark, d, "xgboost")


@query("train_all")
def train_all(spark, d):
    p = prepared(spark, d)
    # the longest fits first
    fitted = dict(_together(*(lambda n=n: (n, model(spark, d, n)) for n in reversed(T.CANDIDATES))))
    return E.comparison(T.test_metrics(p, {n: fitted[n] for n in T.CANDIDATES}))


# ------------------------------------------------------------------ T9-T11
@query("ablation_groups")
def ablation_groups(spark, d):
    def one(label, groups):
        p = prepared(spark, d, groups=groups)
        m = model(spark, d, "random_forest", groups=groups)
        return _metrics_rows(T.test_metrics(p, {"random_forest": m})).withColumn("feature_group", F.lit(label))

    variants = [("raw", ["raw"]), ("temporal", ["temporal"]), ("raw+temporal", ["raw", "temporal"])]
    return reduce(DataFrame.unionByName, _together(*(lambda v=v: one(*v) for v in variants)))


def _balance(p):
    return p.data.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("label").alias("positive_rate"))


@query("ablation_split")
def ablation_split(spark, d):
    def one(split):
        p = prepared(spark, d, split)
        m = model(spark, d, "xgboost", split=split)
        test_rate = _balance(p).where(F.col("split") == "test").select(F.round("positive_rate", 6).alias("test_positive_rate"))
        row = _metrics_rows(T.test_metrics(p, {"xgboost": m})).withColumn("validation_strategy", F.lit(split))
        return row.crossJoin(test_rate)

    return reduce(DataFrame.unionByName, _together(*(lambda s=s: one(s) for s in ("stratified", "holdout"))))


@query("ablation_imbalance")
def ablation_imbalance(spark, d):
    p = prepared(spark, d)

    def one(name, weighted):
        m = model(spark, d, name, weighted)
        return _metrics_rows(T.test_metrics(p, {name: m})).withColumn("class_weighting", F.lit(weighted))

    # the longest fits first
    *boosted, f1, f2 = _together(*(lambda n=n, w=w: one(n, w) for n in ("xgboost", "random_forest") for w in (True, False)))
    return reduce(DataFrame.unionByName, [f1, f2, *boosted])


# ------------------------------------------------------------------ T12
@query("model_roundtrip")
def model_roundtrip(spark, d):
    p = prepared(spark, d)
    m = model(spark, d, "random_forest")
    path = T.save_model(m, p, scratch_path(spark, "model_rf"), "1.0.0")
    loaded, meta = T.load_model(spark, path)
    a = T.probabilities(m, p.data, ["machine_id"]).withColumnRenamed("p", "p_fit")
    b = T.probabilities(loaded, p.data, ["machine_id"]).withColumnRenamed("p", "p_loaded")
    return a.join(b, "machine_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("p_fit") - F.col("p_loaded"))).alias("max_abs_diff"),
        F.lit(len(meta["feature_columns"])).alias("n_features"))


# ------------------------------------------------------------------ T13
TEL_SENSORS = ["vibration", "pressure"]


def telemetry_prepared(spark, d):
    def build():
        t = telemetry(spark, d)
        t = L.horizon_label(t, 24, out="label")
        t = W.lag_rolling(t, TEL_SENSORS, key_cols=["event_id"])
        t = W.trend(t, TEL_SENSORS, key_cols=["event_id"])
        t = D.split_chronological(t, "timestamp", ["event_id"])
        feats = [c for c in t.columns if any(c.startswith(s + "_") for s in TEL_SENSORS)]
        t = t.select("event_id", "split", "label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                                      for c in feats])
        t = cut_lineage(T.with_weights(t, t.where(F.col("split") == "train")))
        return T.Prepared(t, feats, {}, {}, {}, {"key": "event_id"})
    return _memo(spark, d, ("telemetry",), build)


@query("telemetry_model")
def telemetry_model(spark, d):
    p = telemetry_prepared(spark, d)
    m = _memo(spark, d, ("telemetry_rf",), lambda: T.fit(p, "random_forest"))
    return _metrics_rows(T.test_metrics(p, {"random_forest_flat": m}))


# ------------------------------------------------------------------ I3 with a fitted model
@query("batch_score")
def batch_score(spark, d):
    p = prepared(spark, d)
    m = model(spark, d, "random_forest")
    rows = processed_export(spark, d)
    from upkeep.operators import features as X

    mat = X.feature_matrix(rows, p.categories, p.meta["groups"], list(p.weights) + X.RATIO_COLUMNS, keep=["machine_id"])
    aligned = align_features(mat, p.feature_columns, keep=["machine_id"])
    probs = T.probabilities(m, aligned, ["machine_id"]).withColumnRenamed("p", "probability")
    th = p.thresholds
    return classify(probs, "probability", th["watch_threshold"], th["high_threshold"])


# ------------------------------------------------------------------ I4 / I5 trees
def forest_attributions(spark, d):
    """All features' attributions of the test rows by the forest, against
    ``BACKGROUND_ROWS`` md5-chosen train rows, with the additivity gap."""
    def build():
        p = prepared(spark, d)
        m = model(spark, d, "random_forest")
        bg = background_sample(p.part("train"), "machine_id", n=BACKGROUND_ROWS)
        att = ATT.tree_attributions(p.part("test"), "machine_id", p.feature_columns, m.stages[-1], bg, top_k=None)
        base = T.probabilities(m, bg, ["machine_id"]).agg(F.avg("p").alias("base"))
        return cut_lineage(ATT.with_additivity(att, T.probabilities(m, p.part("test"), ["machine_id"]), base, "machine_id"))
    return _memo(spark, d, ("forest_attributions",), build)


@query("attribution_tree")
def attribution_tree(spark, d):
    """The top features of each test row; ``gap`` is Σφ − (f(x) − mean f(background))."""
    found = forest_attributions(spark, d).where(F.col("importance_rank") <= ATT.TOP_K)
    return found.withColumn("gap", F.round("gap", 6) + F.lit(0.0))


@query("global_importance_forest")
def global_importance_forest(spark, d):
    """Mean |φ| of every feature over the test rows."""
    return ATT.global_importance(forest_attributions(spark, d))
