"""Queries for feasibility (F), row features (X) and per-machine windows (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from upkeep.functions.columns import md5_order, r6, r6d
from upkeep.plans.sqlfrag import r6d as r6d_sql
from upkeep.operators import feasibility as FE
from upkeep.operators import features as X
from upkeep.operators import timeseries as W
from upkeep.operators.labels import horizon_label as _horizon
from upkeep.plans.bindings import processed_export, standard_telemetry
from upkeep.plans.oracle import with_ctes
from upkeep.plans.registry import query
from upkeep.schema import COMPLIANCE_FIELDS, DEFAULT_WEIGHTS, FIELD_DICTIONARY
from upkeep.sources.files import scratch_path
from upkeep.sources.testdata import telemetry

DATASETS = [("processed_export", processed_export), ("standard_telemetry", standard_telemetry)]


def _both(fn):
    def run(spark, d):
        out = None
        for name, binding in DATASETS:
            part = fn(binding(spark, d), name)
            out = part if out is None else out.unionByName(part)
        return out
    return run


# ------------------------------------------------------------------ F oracle pieces
def _sig(c: str) -> str:
    z = f"coalesce(CAST({c} AS DOUBLE), 0.0)"
    return f"(count({c}) > 0 AND min({z}) <> max({z}))"


def _metrics_sql(src: str, extras_numeric: list[str]) -> str:
    ncols = len(FIELD_DICTIONARY) + 1 + (3 if src == "processed_export" else 1)
    sig = " OR ".join(_sig(c) for c in COMPLIANCE_FIELDS + extras_numeric)
    return f"""
SELECT '{src}' AS dataset, count(*) AS row_count, CAST({ncols} AS BIGINT) AS column_count,
  CAST(count(DISTINCT machine_id) AS BIGINT) AS machine_count,
  CASE WHEN count(DISTINCT machine_id) > 0 THEN round(count(*) / count(DISTINCT machine_id), 2) ELSE 0.0 END
    AS records_per_machine_mean,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS duplicate_row_count,
  count(failure_label) > 0 AS has_failure_label,
  ({sig}) AS has_priority_signal,
  CAST(min(last_completed_pm) AS DATE) AS min_pm, CAST(max(last_completed_pm) AS DATE) AS max_pm,
  CAST(min(last_completed_wo) AS DATE) AS min_wo, CAST(max(last_completed_wo) AS DATE) AS max_wo
FROM {src}"""


F_CTES = [
    ("m0", _metrics_sql("processed_export", ["extra__spare_parts_count"]) + "\nUNION ALL\n"
     + _metrics_sql("standard_telemetry", ["extra__event_id"])),
    ("m", "SELECT *, machine_count > 0 AND records_per_machine_mean < 1.5 AS is_single_snapshot FROM m0"),
]
F_USES = ["processed_export", "standard_telemetry"]


@query("feasibility_structure", with_ctes(F_USES, "SELECT dataset, row_count, column_count, machine_count, "
                                          "records_per_machine_mean, duplicate_row_count FROM m", F_CTES))
def feasibility_structure(spark, d):
    return _both(FE.structure)(spark, d)


@query("feasibility_date_range", with_ctes(F_USES, """
SELECT dataset, 'last_completed_pm' AS field, min_pm AS min_date, max_pm AS max_date FROM m WHERE min_pm IS NOT NULL
UNION ALL
SELECT dataset, 'last_completed_wo', min_wo, max_wo FROM m WHERE min_wo IS NOT NULL""", F_CTES))
def feasibility_date_range(spark, d):
    return _both(FE.date_ranges)(spark, d)


_TASKS_SQL = """
SELECT dataset, 'task' AS kind, 'binary_failure_classification' AS item FROM m WHERE has_failure_label
UNION ALL SELECT dataset, 'limitation', 'no_failure_label' FROM m WHERE NOT has_failure_label
UNION ALL SELECT dataset, 'task', 'intervention_priority_classification' FROM m WHERE has_priority_signal AND machine_count > 0
UNION ALL SELECT dataset, 'limitation', 'no_priority_signal' FROM m WHERE NOT (has_priority_signal AND machine_count > 0)
UNION ALL SELECT dataset, 'limitation', 'single_snapshot' FROM m WHERE is_single_snapshot
UNION ALL SELECT dataset, 'task', 'time_series_analysis' FROM m
  WHERE NOT is_single_snapshot AND (min_pm IS NOT NULL OR min_wo IS NOT NULL)
UNION ALL SELECT dataset, 'task', 'anomaly_detection_across_machines' FROM m WHERE machine_count > 1 AND has_priority_signal
"""


@query("feasibility_tasks", with_ctes(F_USES, _TASKS_SQL, F_CTES))
def feasibility_tasks(spark, d):
    return _both(FE.tasks)(spark, d)


def _report_sql() -> str:
    metric_rows = " UNION ALL ".join(
        f"SELECT dataset, 'structure' AS section, '{c}' AS item, CAST({c} AS VARCHAR) AS value FROM m"
        for c in ["row_count", "column_count", "machine_count", "records_per_machine_mean", "duplicate_row_count"])
    dates = ("SELECT dataset, 'date_range', 'last_completed_pm', CAST(min_pm AS VARCHAR) || ' to ' || "
             "CAST(max_pm AS VARCHAR) FROM m WHERE min_pm IS NOT NULL UNION ALL SELECT dataset, 'date_range', "
             "'last_completed_wo', CAST(min_wo AS VARCHAR) || ' to ' || CAST(max_wo AS VARCHAR) FROM m "
             "WHERE min_wo IS NOT NULL")
    cols = [f[0] for f in FIELD_DICTIONARY] + ["source_dataset"]
    miss = []
    for src, extras in [("processed_export", ["extra__serial_number", "extra__spare_parts_count",
                                              "extra__irrelevant_notes"]),
                        ("standard_telemetry", ["extra__event_id"])]:
        for c in cols + extras:
            miss.append(f"SELECT '{src}', 'missingness', '{c}', CAST(coalesce(round(avg(CASE WHEN \"{c}\" IS NULL "
                        f"THEN 1.0 ELSE 0.0 END::DOUBLE) * 100, 2), 0.0) AS VARCHAR) FROM {src}")
    tasks = f"SELECT dataset, kind, item, 'yes' FROM ({_TASKS_SQL})"
    return with_ctes(F_USES, " UNION ALL ".join([metric_rows, dates] + miss + [tasks]), F_CTES)


@query("feasibility_report", _report_sql())
def feasibility_report(spark, d):
    return _both(FE.report)(spark, d)


# ------------------------------------------------------------------ X
_DAY = 86400000000
_REF = "(SELECT greatest(max(last_completed_pm), max(last_completed_wo)) FROM processed_export)"


def _days(c: str) -> str:
    return (f"CAST(floor((epoch_us({_REF}) - epoch_us({c})) / {_DAY}) AS BIGINT)")


_RAW_SQL = ", ".join(COMPLIANCE_FIELDS)
_RATIO_SQL = ("round(overdue_pms / (total_completed_pms + 1), 6) AS pm_overdue_ratio, "
              "round(overdue_wos / (total_completed_wos + 1), 6) AS wo_overdue_ratio, "
              "round(downtime_minutes / (total_completed_wos + 1), 6) AS downtime_per_completed_wo, "
              "round(CASE WHEN total_completed_pms + overdue_pms > 0 THEN total_completed_pms / "
              "(total_completed_pms + overdue_pms) ELSE 1.0 END, 6) AS pm_compliance_rate")
_REC_SQL = (f"{_days('last_completed_pm')} AS days_since_last_completed_pm, "
            f"{_days('last_completed_wo')} AS days_since_last_completed_wo")


def _round_ratios(df):
    return df.select(*[r6(F.col(c)).alias(c) if c in X.RATIO_COLUMNS else F.col(c) for c in df.columns])


@query("features_raw", with_ctes(["processed_export"], f"SELECT machine_id, {_RAW_SQL} FROM processed_export"))
def features_raw(spark, d):
    return X.build_numeric(processed_export(spark, d), ["raw"], keep=["machine_id"])


@query("features_extra", with_ctes(["processed_export"], "SELECT machine_id, extra__spare_parts_count FROM processed_export"))
def features_extra(spark, d):
    return X.build_numeric(processed_export(spark, d), ["extra"], keep=["machine_id"])


@query("features_ratios", with_ctes(["processed_export"], f"SELECT machine_id, {_RATIO_SQL} FROM processed_export"))
def features_ratios(spark, d):
    return _round_ratios(X.build_numeric(processed_export(spark, d), ["statistical"], keep=["machine_id"]))


@query("features_recency", with_ctes(["processed_export"], f"SELECT machine_id, {_REC_SQL} FROM processed_export"))
def features_recency(spark, d):
    return X.build_numeric(processed_export(spark, d), ["temporal"], keep=["machine_id"])


@query("features_selected", with_ctes(["processed_export"],
       f"SELECT machine_id, {_RAW_SQL}, {_REC_SQL}, {_RATIO_SQL}, extra__spare_parts_count FROM processed_export"))
def features_selected(spark, d):
    return _round_ratios(X.build_numeric(processed_export(spark, d), keep=["machine_id"]))


# one-hot: categories fitted on the md5 "train" rows only
_TRAIN_CUT = "b3"
_CATS = ["equipment_category", "manufacturer", "criticality"]


def _train_rows(df):
    return df.where(md5_order(42, "machine_id") < F.lit(_TRAIN_CUT))


def _category_table(spark, p):
    return X.category_table(_train_rows(p), _CATS, scratch_path(spark, "categories"))


_ONEHOT_SQL = with_ctes(["processed_export"], "SELECT p.machine_id, t.col || '_' || t.v AS feature FROM processed_export p "
                        "JOIN cats t ON t.v = CASE t.col " + " ".join(
                            f"WHEN '{c}' THEN coalesce(CAST(p.{c} AS VARCHAR), 'None')" for c in _CATS) + " END",
                        [("cats", " UNION ".join(
                            f"SELECT DISTINCT '{c}' AS col, coalesce(CAST({c} AS VARCHAR), 'None') AS v "
                            f"FROM processed_export WHERE md5('42:' || CAST(machine_id AS VARCHAR)) < '{_TRAIN_CUT}'"
                            for c in _CATS))])


@query("onehot_encode", _ONEHOT_SQL)
def onehot_encode(spark, d):
    p = processed_export(spark, d)
    active = X.with_categories(p.select("machine_id", *_CATS), _category_table(spark, p), _CATS)
    return active.select("machine_id", F.explode("active.name").alias("feature"))


_KEEP_NUM = ["total_completed_pms", "total_completed_wos", "total_cost"]


_CATS_CTE = ("cats", " UNION ".join(
    f"SELECT DISTINCT '{c}' AS col, coalesce(CAST({c} AS VARCHAR), 'None') AS v "
    f"FROM processed_export WHERE md5('42:' || CAST(machine_id AS VARCHAR)) < '{_TRAIN_CUT}'" for c in _CATS))
_ACTIVE_CTE = ("active", "SELECT p.machine_id, string_agg(t.col || '_' || t.v, '|' ORDER BY t.col || '_' || t.v) AS a "
               "FROM processed_export p JOIN cats t ON t.v = CASE t.col " + " ".join(
                   f"WHEN '{c}' THEN coalesce(CAST(p.{c} AS VARCHAR), 'None')" for c in _CATS)
               + " END GROUP BY p.machine_id")
_NUM_SQL = ", ".join(f"coalesce(CAST(p.{c} AS DOUBLE), 0.0) AS {c}" for c in _KEEP_NUM)


@query("feature_matrix", with_ctes(["processed_export"], f"""
SELECT p.machine_id, {_NUM_SQL},
  coalesce(CAST({_days('p.last_completed_pm')} AS DOUBLE), 0.0) AS days_since_last_completed_pm,
  coalesce(CAST({_days('p.last_completed_wo')} AS DOUBLE), 0.0) AS days_since_last_completed_wo,
  coalesce(p.extra__spare_parts_count, 0.0) AS extra__spare_parts_count,
  coalesce(o.a, '') AS onehot_active
FROM processed_export p LEFT JOIN active o ON o.machine_id = p.machine_id""", [_CATS_CTE, _ACTIVE_CTE]))
def feature_matrix(spark, d):
    p = processed_export(spark, d)
    drop = list(DEFAULT_WEIGHTS) + X.RATIO_COLUMNS
    m = X.feature_matrix(p, {}, ["raw", "temporal", "extra"], drop, keep=["machine_id", *_CATS])
    m = X.with_categories(m, _category_table(spark, p), _CATS)
    names = F.array_join(F.array_sort("active.name"), "|")
    return m.select(*[c for c in m.columns if c not in (*_CATS, "active")], names.alias("onehot_active"))


# ------------------------------------------------------------------ W (telemetry)
SENSORS = ["vibration", "pressure"]
_WSPEC = 'PARTITION BY machine_id ORDER BY "timestamp", event_id'
KEY = ["event_id"]


def _tel(spark, d):
    return telemetry(spark, d)


@query("lag_features", with_ctes(["telemetry"], "SELECT event_id, " + ", ".join(
    f"lag({s}, {k}) OVER ({_WSPEC}) AS {s}_lag_{k}" for s in SENSORS for k in (1, 3, 6)) + " FROM telemetry"))
def lag_features(spark, d):
    t = W.lag_rolling(_tel(spark, d), SENSORS, windows=[], key_cols=KEY)
    return t.select("event_id", *[c for c in t.columns if "_lag_" in c])


def _roll_sql(fn: str, tag: str) -> str:
    return with_ctes(["telemetry"], "SELECT event_id, " + ", ".join(
        r6d_sql(f"{fn}({s}) OVER ({_WSPEC} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)") + f" AS {s}_{tag}_{n}"
        for s in SENSORS for n in (3, 6, 12, 24)) + " FROM telemetry")


def _roll(spark, d, tag):
    t = W.lag_rolling(_tel(spark, d), SENSORS, lags=[], key_cols=KEY)
    return t.select("event_id", *[r6d(F.col(c)).alias(c) for c in t.columns if f"_{tag}_" in c])


@query("rolling_mean", _roll_sql("avg", "rolling_mean"))
def rolling_mean(spark, d):
    return _roll(spark, d, "rolling_mean")


@query("rolling_std", _roll_sql("stddev_samp", "rolling_std"))
def rolling_std(spark, d):
    return _roll(spark, d, "rolling_std")


def _trend(spark, d, part, suffix):
    t = W.trend(_tel(spark, d), SENSORS, key_cols=KEY, parts=(part,))
    return t.select("event_id", *[r6(F.col(c)).alias(c) for c in t.columns if c.endswith(suffix)])


@query("trend_diff", with_ctes(["telemetry"], "SELECT event_id, " + ", ".join(
    f"round({s} - lag({s}, 1) OVER ({_WSPEC}), 6) AS {s}_diff_1" for s in SENSORS) + " FROM telemetry"))
def trend_diff(spark, d):
    return _trend(spark, d, "diff", "_diff_1")


@query("trend_pct_change", with_ctes(["telemetry"], "SELECT event_id, " + ", ".join(
    f"round(CASE WHEN lag(ff_{s}, 1) OVER ({_WSPEC}) = 0 THEN NULL ELSE ff_{s} / lag(ff_{s}, 1) OVER ({_WSPEC}) - 1 END, 6)"
    f" AS {s}_pct_change_1" for s in SENSORS) + " FROM ff", [("ff", "SELECT *, " + ", ".join(
        f"last_value({s} IGNORE NULLS) OVER ({_WSPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff_{s}"
        for s in SENSORS) + " FROM telemetry")]))
def trend_pct_change(spark, d):
    return _trend(spark, d, "pct_change", "_pct_change_1")


def _ewma_sql(span: int = 6) -> str:
    a = 2.0 / (span + 1.0)
    b = 1.0 - a
    step = []
    for s in SENSORS:
        ow2 = f"(r.ow_{s} * {b!r})"
        step.append(f"""CASE WHEN r.y_{s} IS NULL THEN t.{s} WHEN t.{s} IS NULL THEN r.y_{s}
          WHEN r.y_{s} = t.{s} THEN r.y_{s}
          ELSE ({ow2} * r.y_{s} + {a!r} * t.{s}) / ({ow2} + {a!r}) END AS y_{s},
        CASE WHEN r.y_{s} IS NULL THEN 1.0 WHEN t.{s} IS NULL THEN {ow2} ELSE 1.0 END AS ow_{s}""")
    init = ", ".join(f"{s} AS y_{s}, CAST(1.0 AS DOUBLE) AS ow_{s}" for s in SENSORS)
    body = f"""
WITH RECURSIVE t AS (
  SELECT machine_id, event_id, {", ".join(SENSORS)}, row_number() OVER ({_WSPEC}) AS rn FROM telemetry),
r AS (
  SELECT machine_id, rn, event_id, {init} FROM t WHERE rn = 1
  UNION ALL
  SELECT t.machine_id, t.rn, t.event_id, {", ".join(step)}
  FROM r JOIN t ON t.machine_id = r.machine_id AND t.rn = r.rn + 1)
SELECT event_id, {", ".join(f"round(y_{s}, 6) AS {s}_ewma_{span}" for s in SENSORS)} FROM r"""
    from upkeep.plans.oracle import CTE

    return body.replace("WITH RECURSIVE t AS (", f"WITH RECURSIVE telemetry AS ({CTE['telemetry'].strip()}),\nt AS (", 1)


@query("trend_ewma", _ewma_sql())
def trend_ewma(spark, d):
    return _trend(spark, d, "ewma", "_ewma_6")


SEQ_LEN = 24


@query("sequence_windows", with_ctes(["telemetry"], f"""
SELECT machine_id, event_id, n_steps, round(vibration_sum, 6) AS vibration_sum, round(pressure_sum, 6) AS pressure_sum,
       label FROM (
  SELECT machine_id, event_id, row_number() OVER ({_WSPEC}) AS rn,
    count(*) OVER ({_WSPEC} ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW) AS n_steps,
    sum(vibration) OVER ({_WSPEC} ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW) AS vibration_sum,
    sum(pressure) OVER ({_WSPEC} ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW) AS pressure_sum,
    failure_label AS label
  FROM telemetry) WHERE rn >= {SEQ_LEN}"""))
def sequence_windows(spark, d):
    s = W.sequence_windows(_tel(spark, d), SENSORS, SEQ_LEN, "failure_label", key_cols=KEY)

    def total(field):
        vals = F.filter(F.transform("seq", lambda e: e[field]), lambda v: v.isNotNull())
        return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v))

    return s.select("machine_id", "event_id", F.size("seq").cast("bigint").alias("n_steps"),
                    r6(total("vibration")).alias("vibration_sum"), r6(total("pressure")).alias("pressure_sum"),
                    "label")


@query("horizon_label", with_ctes(["telemetry"], """
SELECT t.event_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM telemetry f WHERE f.machine_id = t.machine_id
  AND f.failure_label = 1 AND f."timestamp" > t."timestamp"
  AND f."timestamp" <= t."timestamp" + INTERVAL 24 HOUR) THEN 1 ELSE 0 END AS INTEGER) AS failure_within_horizon
FROM telemetry t"""))
def horizon_label(spark, d):
    return _horizon(_tel(spark, d), 24).select("event_id", "failure_within_horizon")
