"""Queries for splits (D) and evaluation (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from upkeep.functions.columns import r6
from upkeep.operators import metrics as E
from upkeep.operators import splits as D
from upkeep.operators.labels import priority_score
from upkeep.plans.oracle import with_ctes
from upkeep.plans.registry import query
from upkeep.plans.serving_data import candidates, labeled, scored
from upkeep.sources.testdata import asset_snapshot, telemetry

_CUT = ("CASE WHEN pos <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' "
        "WHEN pos <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END")
_TWO_STAGE = ("CASE WHEN pos <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' "
              "WHEN pos <= floor(n * CAST(0.7 AS DOUBLE)) + floor((n - floor(n * CAST(0.7 AS DOUBLE))) * "
              f"CAST({0.15 / (0.15 + 0.15)!r} AS DOUBLE)) THEN 'val' ELSE 'test' END")


# ------------------------------------------------------------------ D1
@query("split_chronological", with_ctes(["telemetry"], f"""
SELECT event_id, {_CUT} AS split FROM (
  SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) AS pos, count(*) OVER () AS n FROM telemetry)"""))
def split_chronological(spark, d):
    return D.split_chronological(telemetry(spark, d), "timestamp", ["event_id"]).select("event_id", "split")


# ------------------------------------------------------------------ D2
_PROV = ("SELECT machine_id, label, CAST(CASE WHEN priority_score > (SELECT median(priority_score) FROM labeled) "
         "THEN 1 ELSE 0 END AS INTEGER) AS provisional FROM labeled")
_STRAT = ("SELECT machine_id, label, provisional, row_number() OVER (PARTITION BY provisional ORDER BY "
          "md5('42:' || CAST(machine_id AS VARCHAR)), machine_id) AS pos, count(*) OVER (PARTITION BY provisional) AS n "
          "FROM prov")


def _stratified(spark, d):
    lab = D.provisional_label(labeled(spark, d))
    return D.split_stratified(lab, "provisional", "machine_id")


@query("split_stratified", with_ctes(["labeled"], f"SELECT machine_id, provisional, {_TWO_STAGE} AS split FROM strat",
                                     [("prov", _PROV), ("strat", _STRAT)]))
def split_stratified(spark, d):
    return _stratified(spark, d).select("machine_id", "provisional", "split")


# ------------------------------------------------------------------ D3
@query("split_holdout", with_ctes(["telemetry"], f"""
SELECT t.event_id, t.machine_id, m.split FROM telemetry t JOIN (
  SELECT machine_id, {_TWO_STAGE} AS split FROM (
    SELECT machine_id, row_number() OVER (ORDER BY md5('42:' || CAST(machine_id AS VARCHAR)), machine_id) AS pos,
           count(*) OVER () AS n FROM (SELECT DISTINCT machine_id FROM telemetry WHERE machine_id IS NOT NULL))
) m ON m.machine_id = t.machine_id"""))
def split_holdout(spark, d):
    return D.split_holdout(telemetry(spark, d)).select("event_id", "machine_id", "split")


# ------------------------------------------------------------------ D4
@query("split_balance", with_ctes(["labeled"], f"""
SELECT split, count(*) AS n_rows, round(avg(CAST(label AS DOUBLE)), 6) AS positive_rate
FROM (SELECT label, {_TWO_STAGE} AS split FROM strat) GROUP BY split""", [("prov", _PROV), ("strat", _STRAT)]))
def split_balance(spark, d):
    return D.split_balance(_stratified(spark, d), "split", "label")


# ------------------------------------------------------------------ E on the scored table
def _yp(spark, d):
    return scored(spark, d).select(F.col("label").alias("y"), F.col("probability").alias("p"))


_YP = ("yp", "SELECT label AS y, probability AS p FROM scored")
_CM = ("SELECT count_if(y = 0 AND p < 0.5) AS tn, count_if(y = 0 AND p >= 0.5) AS fp, "
       "count_if(y = 1 AND p < 0.5) AS fn, count_if(y = 1 AND p >= 0.5) AS tp FROM yp")


@query("confusion_matrix", with_ctes(["scored"], _CM, [_YP]))
def confusion_matrix(spark, d):
    s = _yp(spark, d).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return E.confusion(s, [], "y", "pred")


_MET = ("round(CASE WHEN tn + fp + fn + tp = 0 THEN 0.0 ELSE (tp + tn) / (tn + fp + fn + tp) END, 6) AS accuracy, "
        "round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, "
        "round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall, "
        "round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1")


@query("classification_metrics", with_ctes(["scored"], f"SELECT {_MET} FROM ({_CM})", [_YP]))
def classification_metrics(spark, d):
    s = _yp(spark, d).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    m = E.threshold_metrics(E.confusion(s, [], "y", "pred"))
    return m.select(*[r6(F.col(c)).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


_CUM = ("cum", "SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS cum_pos, sum(neg) OVER (ORDER BY p DESC) "
               "AS cum_neg, row_number() OVER (ORDER BY p DESC) AS rk FROM (SELECT p, CAST(sum(y) AS BIGINT) AS pos, "
               "CAST(count(*) - sum(y) AS BIGINT) AS neg FROM yp GROUP BY p)")
_TOT = ("tot", "SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg FROM yp")


@query("roc_auc", with_ctes(["scored"], """
SELECT round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN sum(neg * (cum_pos - pos + pos / 2.0)) / (n_pos * n_neg) END, 6) AS roc_auc
FROM cum, tot GROUP BY n_pos, n_neg""", [_YP, _CUM, _TOT]))
def roc_auc(spark, d):
    return E.ranking_metrics(_yp(spark, d), []).select(r6(F.col("roc_auc")).alias("roc_auc"))


@query("average_precision", with_ctes(["scored"], """
SELECT round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN sum(pos * (cum_pos / (cum_pos + cum_neg))) / n_pos END, 6) AS pr_auc
FROM cum, tot GROUP BY n_pos, n_neg""", [_YP, _CUM, _TOT]))
def average_precision(spark, d):
    return E.ranking_metrics(_yp(spark, d), []).select(r6(F.col("pr_auc")).alias("pr_auc"))


@query("roc_curve", with_ctes(["scored"], """
SELECT 0.0 AS fpr, 0.0 AS tpr, CAST(NULL AS DOUBLE) AS threshold
UNION ALL
SELECT round(cum_neg / n_neg, 6), round(cum_pos / n_pos, 6), p FROM (
  SELECT c.*, lag(cum_pos) OVER w AS pp, lag(cum_neg) OVER w AS pn, lead(cum_pos) OVER w AS np,
         lead(cum_neg) OVER w AS nn, count(*) OVER () AS m
  FROM cum c WINDOW w AS (ORDER BY rk)), tot
WHERE rk = 1 OR rk = m OR np - 2 * cum_pos + pp <> 0 OR nn - 2 * cum_neg + pn <> 0""", [_YP, _CUM, _TOT]))
def roc_curve(spark, d):
    c = E.roc_curve(_yp(spark, d), [])
    return c.select(r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"), "threshold")


@query("pr_curve", with_ctes(["scored"], """
SELECT round(cum_pos / (cum_pos + cum_neg), 6) AS precision, round(CASE WHEN n_pos = 0 THEN 1.0 ELSE cum_pos / n_pos END, 6)
       AS recall, p AS threshold FROM cum, tot
UNION ALL SELECT 1.0, 0.0, CAST(NULL AS DOUBLE)""", [_YP, _CUM, _TOT]))
def pr_curve(spark, d):
    c = E.pr_curve(_yp(spark, d), [])
    return c.select(r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"), "threshold")


# ------------------------------------------------------------------ E7 / E8 over the candidate scorers
def candidate_metrics(spark, d):
    c = candidates(spark, d)
    m = E.evaluate(c, ["model", "candidate_order"], "y", "p")
    return m


_CAND_CTES = [
    ("cm", "SELECT model, candidate_order, count_if(y = 0 AND p < 0.5) AS tn, count_if(y = 0 AND p >= 0.5) AS fp, "
           "count_if(y = 1 AND p < 0.5) AS fn, count_if(y = 1 AND p >= 0.5) AS tp FROM candidates "
           "GROUP BY model, candidate_order"),
    ("ccum", "SELECT model, p, pos, neg, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS cum_pos, "
             "sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS cum_neg FROM (SELECT model, p, "
             "CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg FROM candidates GROUP BY model, p)"),
    ("ctot", "SELECT model, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg FROM candidates "
             "GROUP BY model"),
    ("rk", "SELECT ccum.model, CASE WHEN n_pos > 0 AND n_neg > 0 THEN sum(neg * (cum_pos - pos + pos / 2.0)) / (n_pos * n_neg) END "
           "AS roc_auc, CASE WHEN n_pos > 0 AND n_neg > 0 THEN sum(pos * (cum_pos / (cum_pos + cum_neg))) / n_pos END AS pr_auc "
           "FROM ccum JOIN ctot USING (model) GROUP BY ccum.model, n_pos, n_neg"),
    ("met", "SELECT cm.model, candidate_order, CASE WHEN tn + fp + fn + tp = 0 THEN 0.0 ELSE (tp + tn) / "
            "(tn + fp + fn + tp) END AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, "
            "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 "
            "ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, roc_auc, pr_auc FROM cm JOIN rk USING (model)"),
    ("best", "SELECT arg_max(model, (coalesce(pr_auc, 0.0), recall, -candidate_order)) AS selected_model FROM met"),
]


@query("select_model", with_ctes(["candidates"], "SELECT selected_model FROM best", _CAND_CTES))
def select_model(spark, d):
    return E.select_model(candidate_metrics(spark, d))


@query("model_comparison", with_ctes(["candidates"], """
SELECT model, round(accuracy, 3) AS accuracy, round(precision, 3) AS precision, round(recall, 3) AS recall,
       round(f1, 3) AS f1, round(roc_auc, 3) AS roc_auc, round(pr_auc, 3) AS pr_auc, model = selected_model AS selected
FROM met, best""", _CAND_CTES))
def model_comparison(spark, d):
    return E.comparison(candidate_metrics(spark, d))
