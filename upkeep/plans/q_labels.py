"""Queries for the priority score and labels (L1-L8) — the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from upkeep.functions.columns import r6
from upkeep.operators import labels as L
from upkeep.plans.oracle import with_ctes
from upkeep.plans.registry import query
from upkeep.schema import DEFAULT_WEIGHTS
from upkeep.sources.testdata import asset_snapshot

KNOWN = list(DEFAULT_WEIGHTS)


def z_sql(c: str) -> str:
    return f"coalesce(CAST({c} AS DOUBLE), 0.0)"


def params_sql(cols: list[str], src: str) -> str:
    return "SELECT " + ", ".join(
        f"min({z_sql(c)}) AS mn_{c}, max({z_sql(c)}) AS mx_{c}" for c in cols
    ) + f" FROM {src}"


def score_sql(weights: dict[str, float]) -> str:
    terms = [
        f"CAST({w!r} AS DOUBLE) * (CASE WHEN mx_{c} - mn_{c} > 0 THEN ({z_sql(c)} - mn_{c}) / (mx_{c} - mn_{c}) "
        f"ELSE {z_sql(c)} * 0.0 END)"
        for c, w in weights.items()
    ]
    return "(" + " + ".join(terms) + f") / CAST({float(sum(weights.values()))!r} AS DOUBLE)"


LEVEL_SQL = ("CASE WHEN {s} >= high_threshold THEN 'High Priority' WHEN {s} >= watch_threshold THEN 'Watch' "
             "ELSE 'Normal' END")

# Shared oracle CTE chain: snapshot → score → thresholds → level → label.
LABELED_CTES = [
    ("params", params_sql(KNOWN, "asset_snapshot")),
    ("scored0", f"SELECT s.*, {score_sql(DEFAULT_WEIGHTS)} AS priority_score FROM asset_snapshot s, params"),
    ("th", "SELECT quantile_cont(priority_score, 0.7) AS watch_threshold, "
           "quantile_cont(priority_score, 0.9) AS high_threshold FROM scored0"),
    ("labeled", "SELECT scored0.*, " + LEVEL_SQL.format(s="priority_score") + " AS intervention_priority, "
                "CAST(CASE WHEN priority_score >= high_threshold THEN 1 ELSE 0 END AS INTEGER) AS label "
                "FROM scored0, th"),
]


def labeled_snapshot(spark, d):
    return L.label_snapshot(asset_snapshot(spark, d))


# ------------------------------------------------------------ flagship
PRIORITY_BY_SEGMENT_SQL = with_ctes(["asset_snapshot"], """
SELECT equipment_category, intervention_priority, count(*) AS n_assets,
       round(avg(priority_score), 6) AS mean_score, CAST(sum(label) AS BIGINT) AS n_high
FROM labeled GROUP BY equipment_category, intervention_priority
""", LABELED_CTES)


@query("priority_by_segment", PRIORITY_BY_SEGMENT_SQL)
def priority_by_segment(spark, d):
    lab = labeled_snapshot(spark, d)
    return lab.groupBy("equipment_category", "intervention_priority").agg(
        F.count(F.lit(1)).alias("n_assets"),
        r6(F.avg("priority_score")).alias("mean_score"),
        F.sum("label").cast("bigint").alias("n_high"),
    )


# ------------------------------------------------------------ L1
SIGNAL_COLS = ["overdue_pms", "overdue_wos", "total_completed_pms", "total_completed_wos",
               "downtime_minutes", "total_cost"]


@query("signal_test", with_ctes(["asset_snapshot"], "UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (count({c}) > 0 AND min({z_sql(c)}) <> max({z_sql(c)})) AS has_signal "
    f"FROM asset_snapshot " for c in SIGNAL_COLS)))
def signal_test(spark, d):
    return L.signal_test(asset_snapshot(spark, d), SIGNAL_COLS)


# ------------------------------------------------------------ L2
@query("resolve_weights", with_ctes(["asset_snapshot"], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 1.0 AS weight FROM asset_snapshot "
    f"HAVING count({c}) > 0 AND min({z_sql(c)}) <> max({z_sql(c)})" for c in KNOWN)))
def resolve_weights(spark, d):
    return L.weights_frame(asset_snapshot(spark, d))


# ------------------------------------------------------------ L3
@query("priority_score", with_ctes(["asset_snapshot"],
       "SELECT machine_id, round(priority_score, 6) AS priority_score FROM scored0", LABELED_CTES[:2]))
def priority_score(spark, d):
    s = L.priority_score(asset_snapshot(spark, d))
    return s.select("machine_id", r6(F.col("priority_score")).alias("priority_score"))


# ------------------------------------------------------------ L4
@query("fit_thresholds", with_ctes(["asset_snapshot"],
       "SELECT round(watch_threshold, 9) AS watch_threshold, round(high_threshold, 9) AS high_threshold FROM th",
       LABELED_CTES[:3]))
def fit_thresholds(spark, d):
    s = L.priority_score(asset_snapshot(spark, d))
    th = L.fit_thresholds(s)
    return th.select(F.round("watch_threshold", 9).alias("watch_threshold"),
                     F.round("high_threshold", 9).alias("high_threshold"))


@query("fit_thresholds_positional", with_ctes(["asset_snapshot"],
       "SELECT round(watch_threshold, 9) AS watch_threshold, round(high_threshold, 9) AS high_threshold FROM th",
       LABELED_CTES[:3]))
def fit_thresholds_positional(spark, d):
    s = L.priority_score(asset_snapshot(spark, d))
    th = L.fit_thresholds(s, method="positional")
    return th.select(F.round("watch_threshold", 9).alias("watch_threshold"),
                     F.round("high_threshold", 9).alias("high_threshold"))


# ------------------------------------------------------------ L5
@query("apply_thresholds", with_ctes(["asset_snapshot"],
       "SELECT machine_id, intervention_priority, label FROM labeled", LABELED_CTES))
def apply_thresholds(spark, d):
    return labeled_snapshot(spark, d).select("machine_id", "intervention_priority", "label")


# ------------------------------------------------------------ L6
@query("classify_risk", with_ctes(["asset_snapshot"],
       "SELECT machine_id, CASE WHEN priority_score >= high_threshold THEN 'High Risk' "
       "WHEN priority_score >= watch_threshold THEN 'Watch' ELSE 'Normal' END AS risk_level FROM scored0, th",
       LABELED_CTES[:3]))
def classify_risk(spark, d):
    s = L.priority_score(asset_snapshot(spark, d))
    return L.classify_risk(s, L.fit_thresholds(s)).select("machine_id", "risk_level")


# ------------------------------------------------------------ L7
@query("provisional_label", with_ctes(["asset_snapshot"],
       "SELECT machine_id, CAST(CASE WHEN priority_score > (SELECT median(priority_score) FROM scored0) "
       "THEN 1 ELSE 0 END AS INTEGER) AS provisional FROM scored0", LABELED_CTES[:2]))
def provisional_label(spark, d):
    from upkeep.operators.splits import provisional_label as prov

    s = L.priority_score(asset_snapshot(spark, d))
    return prov(s).select("machine_id", "provisional")
