"""Scored binding and candidate scorers derived from ``asset_snapshot``.

* ``scored``: snapshot → priority score/labels (L3-L5) → probability of a
  fixed-coefficient logistic model rounded to 6 decimals (creates ties).
* ``candidates``: the same rows scored by three fixed linear models, long
  format ``(model, candidate_order, machine_id, y, p)`` for E7/E8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.operators.labels import label_snapshot
from upkeep.operators.score import linear_margin, score_linear
from upkeep.plans.oracle import register
from upkeep.plans.q_labels import LABELED_CTES
from upkeep.schema import ALERT_STATUSES
from upkeep.sources.testdata import asset_snapshot

# FIXED VALUES — test-binding scorers: (intercept, coefficients); NULL inputs count as 0
LINEAR_MODELS: dict[str, tuple[float, dict[str, float]]] = {
    "linear_a": (-3.0, {"overdue_pms": 0.8, "overdue_wos": 0.5, "downtime_minutes": 0.0008,
                        "total_completed_pms": -0.1, "total_cost": 0.00005}),
    "linear_b": (-2.0, {"overdue_pms": 0.5, "downtime_minutes": 0.001}),
    "linear_c": (-1.5, {"total_completed_wos": -0.2, "total_cost": 0.0001}),
}
PRIMARY = "linear_a"


def labeled(spark: SparkSession, d: str) -> DataFrame:
    return label_snapshot(asset_snapshot(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    b, w = LINEAR_MODELS[PRIMARY]
    return score_linear(labeled(spark, d), w, b)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    lab = labeled(spark, d)
    probs = [
        F.struct(F.lit(name).alias("model"), F.lit(i).alias("candidate_order"),
                 F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_margin(w, b))), 6).alias("p"))
        for i, (name, (b, w)) in enumerate(LINEAR_MODELS.items())
    ]
    return lab.select("machine_id", F.col("label").alias("y"), F.explode(F.array(*probs)).alias("c")).select(
        "c.model", "c.candidate_order", "machine_id", "y", "c.p")


# ---------------------------------------------------------------- oracle side
def margin_sql(name: str) -> str:
    b, w = LINEAR_MODELS[name]
    z = f"CAST({b!r} AS DOUBLE)"
    for c, k in w.items():
        z = f"({z} + CAST({k!r} AS DOUBLE) * coalesce(CAST({c} AS DOUBLE), 0.0))"
    return z


def prob_sql(name: str) -> str:
    return f"round(1.0 / (1.0 + exp(-{margin_sql(name)})), 6)"


for _n, _s in LABELED_CTES:
    register(_n, _s, {"params": ["asset_snapshot"], "scored0": ["params"], "th": ["scored0"],
                      "labeled": ["th"]}[_n])
register("scored", f"SELECT *, {prob_sql(PRIMARY)} AS probability FROM labeled", ["labeled"])
register("candidates", " UNION ALL ".join(
    f"SELECT '{n}' AS model, {i} AS candidate_order, machine_id, label AS y, {prob_sql(n)} AS p FROM labeled"
    for i, n in enumerate(LINEAR_MODELS)), ["labeled"])


# ---------------------------------------------------------------- serving tables (Spark side)
def _dataset(col="criticality"):
    return F.concat(F.lit("cmms_"), F.lower(F.col(col)))


BASE_TS = "1999-01-01 00:00:00"


def machines(spark: SparkSession, d: str) -> DataFrame:
    s = asset_snapshot(spark, d)
    return s.select(
        F.col("machine_id").alias("id"),
        F.concat(F.lit("M-"), F.col("machine_id").cast("string")).alias("machine_identifier"),
        F.col("manufacturer").alias("machine_model"),
        "equipment_category",
        F.lit(None).cast("double").alias("age"),
        _dataset().alias("dataset_id"),
        F.col("last_completed_wo").alias("created_at"),
    )


def model_versions(spark: SparkSession, d: str) -> DataFrame:
    """One version per (dataset, candidate model), created one day apart after
    the dataset's latest completed PM; none active yet."""
    per = asset_snapshot(spark, d).groupBy(_dataset().alias("dataset_id")).agg(
        F.max("last_completed_pm").alias("__t"))
    models = F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(i).alias("k"))
                       for i, n in enumerate(LINEAR_MODELS)])
    v = per.select("dataset_id", "__t", F.explode(models).alias("m"))
    return v.select(
        F.concat_ws(":", "dataset_id", "m.model_name").alias("id"),
        F.concat(F.lit("1.0."), F.col("m.k").cast("string")).alias("version"),
        F.col("m.model_name").alias("model_name"),
        F.lit("linear").alias("model_type"),
        "dataset_id",
        F.lit(0.5).alias("threshold"),
        F.timestamp_add("DAY", F.col("m.k"), F.col("__t")).alias("created_at"),
        F.lit(False).alias("active"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    from upkeep.operators.score import classify

    s = classify(scored(spark, d), "probability")
    ts = F.coalesce(F.col("last_completed_pm"), F.lit(BASE_TS).cast("timestamp_ntz"))
    return s.select(
        F.col("machine_id").alias("id"),
        "machine_id",
        F.concat(_dataset(), F.lit(f":{PRIMARY}")).alias("model_version_id"),
        ts.alias("prediction_timestamp"),
        F.col("probability").alias("failure_probability"),
        "predicted_class",
        "intervention_priority",
        ts.alias("created_at"),
    )


def explanations(spark: SparkSession, d: str) -> DataFrame:
    from upkeep.operators.attribution import linear_attributions
    from upkeep.operators.score import background_sample

    snap = asset_snapshot(spark, d)
    _b, w = LINEAR_MODELS[PRIMARY]
    bg = background_sample(snap, "machine_id")
    att = linear_attributions(snap, "machine_id", w, bg)
    return att.withColumnRenamed("machine_id", "prediction_id")


def alerts(spark: SparkSession, d: str) -> DataFrame:
    from upkeep.operators.serving import alert_filter, alert_message

    p = alert_filter(predictions(spark, d))
    top = explanations(spark, d).where(F.col("importance_rank") == 1).select(
        F.col("prediction_id").alias("id"), F.col("feature_name").alias("__top"))
    j = p.join(top, "id", "left")
    status = F.element_at(F.array(*[F.lit(s) for s in ALERT_STATUSES]), (F.col("machine_id") % 4 + 1).cast("int"))
    ack = F.when(status != "New", F.timestamp_add("DAY", F.lit(1), F.col("prediction_timestamp")))
    closed = F.when(status == "Closed", F.timestamp_add("DAY", F.lit(2), F.col("prediction_timestamp")))
    msg = alert_message(F.concat(F.lit("M-"), F.col("machine_id").cast("string")), F.col("intervention_priority"),
                        F.col("failure_probability"), F.col("model_version_id"), F.col("__top"))
    return j.select(
        "id", F.col("id").alias("prediction_id"), "machine_id", "intervention_priority", msg.alias("message"),
        status.alias("status"), F.col("prediction_timestamp").alias("created_at"),
        ack.alias("acknowledged_at"), closed.alias("closed_at"),
    )


# ---------------------------------------------------------------- serving tables (oracle side)
_DS = "'cmms_' || lower(criticality)"
register("machines", f"""
SELECT machine_id AS id, 'M-' || CAST(machine_id AS VARCHAR) AS machine_identifier, manufacturer AS machine_model,
       equipment_category, CAST(NULL AS DOUBLE) AS age, {_DS} AS dataset_id, last_completed_wo AS created_at
FROM asset_snapshot""", ["asset_snapshot"])
register("model_versions", " UNION ALL ".join(
    f"SELECT dataset_id || ':{n}' AS id, '1.0.{i}' AS version, '{n}' AS model_name, 'linear' AS model_type, dataset_id, "
    f"0.5 AS threshold, t + INTERVAL {i} DAY AS created_at, FALSE AS active FROM (SELECT {_DS} AS dataset_id, "
    f"max(last_completed_pm) AS t FROM asset_snapshot GROUP BY 1)" for i, n in enumerate(LINEAR_MODELS)),
    ["asset_snapshot"])
register("predictions", f"""
SELECT machine_id AS id, machine_id, {_DS} || ':{PRIMARY}' AS model_version_id,
       coalesce(last_completed_pm, TIMESTAMP '{BASE_TS}') AS prediction_timestamp, probability AS failure_probability,
       CAST(CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS predicted_class,
       CASE WHEN probability >= 0.8 THEN 'High Priority' WHEN probability >= 0.5 THEN 'Watch' ELSE 'Normal' END
         AS intervention_priority,
       coalesce(last_completed_pm, TIMESTAMP '{BASE_TS}') AS created_at
FROM scored""", ["scored"])


def _expl_sql() -> str:
    _b, w = LINEAR_MODELS[PRIMARY]
    z = lambda c: f"coalesce(CAST({c} AS DOUBLE), 0.0)"
    mu = ", ".join(f"avg({z(c)}) AS mu_{c}" for c in w)
    rows = " UNION ALL ".join(
        f"SELECT machine_id, '{c}' AS feature_name, {z(c)} AS feature_value, CAST({k!r} AS DOUBLE) * ({z(c)} - mu_{c}) "
        f"AS shap_value FROM asset_snapshot, mu" for c, k in w.items())
    return f"""
SELECT prediction_id, feature_name, feature_value, shap_value, importance_rank FROM (
  SELECT machine_id AS prediction_id, feature_name, feature_value, shap_value,
         CAST(row_number() OVER (PARTITION BY machine_id ORDER BY abs(shap_value) DESC, feature_name) AS INTEGER)
           AS importance_rank
  FROM (WITH mu AS (SELECT {mu} FROM (SELECT * FROM asset_snapshot
          ORDER BY md5('42:' || CAST(machine_id AS VARCHAR)), machine_id LIMIT 100))
        {rows})) WHERE importance_rank <= 5"""


register("explanations", _expl_sql(), ["asset_snapshot"])
_STATUS = "CASE machine_id % 4 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(ALERT_STATUSES)) + " END"
register("alerts", f"""
SELECT p.id, p.id AS prediction_id, p.machine_id, p.intervention_priority,
  'Machine M-' || CAST(p.machine_id AS VARCHAR) || ' classified as ' || p.intervention_priority ||
  ' (failure probability ' || CAST(round_even(CAST(p.failure_probability AS DECIMAL(18,6)), 2) AS VARCHAR) ||
  ', model ' || p.model_version_id || ').' ||
  CASE WHEN e.feature_name IS NULL THEN '' ELSE ' Top contributing factor: ' || e.feature_name || '.' END AS message,
  {_STATUS} AS status, p.prediction_timestamp AS created_at,
  CASE WHEN {_STATUS} <> 'New' THEN p.prediction_timestamp + INTERVAL 1 DAY END AS acknowledged_at,
  CASE WHEN {_STATUS} = 'Closed' THEN p.prediction_timestamp + INTERVAL 2 DAY END AS closed_at
FROM predictions p LEFT JOIN (SELECT prediction_id, feature_name FROM explanations WHERE importance_rank = 1) e
  ON e.prediction_id = p.id
WHERE p.intervention_priority IN ('Watch', 'High Priority')""", ["predictions", "explanations"])
