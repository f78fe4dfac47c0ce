"""Standard schema, field groups and other fixed values.

FIXED VALUES: the names, aliases, word lists and labels below must equal the
behaviour being reproduced, so they are stated plainly, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — canonical field dictionary: name, required flag, lower-case
# substring aliases, numeric flag (numeric fields coerce text sentinels to
# NULL on mapping). Dictionary order matters for mapping suggestions.
# ---------------------------------------------------------------------------
FIELD_DICTIONARY: list[tuple[str, bool, tuple[str, ...], bool]] = [
    ("machine_id", True, ("asset id", "asset name", "machine id", "equipment id", "asset_id"), False),
    ("equipment_category", False, ("equipment category", "category", "asset type"), False),
    ("manufacturer", False, ("manufacturer", "make"), False),
    ("criticality", False, ("criticality", "asset criticality index", "criticality classification"), False),
    ("overdue_pms", False, ("overdue pms",), False),
    ("overdue_wos", False, ("overdue wos",), False),
    ("total_completed_pms", False, ("total completed pms",), False),
    ("total_completed_wos", False, ("total completed wos",), False),
    ("downtime_minutes", False, ("downtime", "total time spent"), False),
    ("total_cost", False, ("total cost", "cost per work order"), False),
    ("last_completed_pm", False, ("last completed pm",), False),
    ("last_completed_wo", False, ("last completed wo",), False),
    ("failure_label", False, ("failure", "breakdown"), False),
    ("timestamp", False, ("timestamp", "reading time", "reading_time"), False),
    ("voltage", False, ("voltage",), False),
    ("rotation", False, ("rotation", "rpm"), False),
    ("pressure", False, ("pressure",), False),
    ("vibration", False, ("vibration",), False),
    ("hierarchy_level", False, ("hierarchy level",), False),
    ("pm_setup_count", False, ("pm setup count",), True),
    ("no_setup_zero_overdue", False, ("no setup zero overdue",), False),
    ("expected_overdue_wos_peer_adjusted", False, ("expected overdue wos peer adjusted",), True),
    ("peer_adjusted_residual", False, ("peer adjusted residual",), True),
    ("global_anomaly_score", False, ("global anomaly score",), True),
    ("rank_raw_overdue", False, ("rank raw overdue",), True),
    ("rank_peer_adjusted", False, ("rank peer adjusted",), True),
    ("rank_global_anomaly", False, ("rank global anomaly",), True),
    ("maintenance_pattern_cluster", False, ("maintenance pattern cluster",), False),
]
FIELD_NAMES = [f[0] for f in FIELD_DICTIONARY]
REQUIRED_FIELDS = [f[0] for f in FIELD_DICTIONARY if f[1]]
NUMERIC_FLAGGED_FIELDS = [f[0] for f in FIELD_DICTIONARY if f[3]]

# FIXED VALUES — field groups
COMPLIANCE_FIELDS = [
    "overdue_pms",
    "overdue_wos",
    "total_completed_pms",
    "total_completed_wos",
    "downtime_minutes",
    "total_cost",
]
TEXT_FIELDS = ["machine_id", "equipment_category", "manufacturer", "criticality"]
DATE_FIELDS = ["last_completed_pm", "last_completed_wo"]
SENSOR_FIELDS = ["voltage", "rotation", "pressure", "vibration"]
CATEGORICAL_FIELDS = ["equipment_category", "manufacturer", "criticality"]
RECENCY_COLUMNS = {
    "last_completed_pm": "days_since_last_completed_pm",
    "last_completed_wo": "days_since_last_completed_wo",
}

# FIXED VALUES — cleaning tokens and fill label
NULL_TOKENS = ["", "nan", "None"]
UNKNOWN_LABEL = "Unknown"

# FIXED VALUES — priority labels, default score weights, alertable levels
NORMAL, WATCH, HIGH = "Normal", "Watch", "High Priority"
HIGH_RISK = "High Risk"
DEFAULT_WEIGHTS = {"overdue_pms": 1.0, "overdue_wos": 1.0, "downtime_minutes": 1.0}
ALERTABLE_LEVELS = [WATCH, HIGH]
ALERT_STATUSES = ["New", "Acknowledged", "Reviewed", "Closed"]

# FIXED VALUES — peer-adjusted analysis columns
PEER_CATEGORICAL = ["hierarchy_level", "maintenance_pattern_cluster"]
PEER_FLAGS = ["no_setup_zero_overdue"]
PEER_NUMERIC = [
    "pm_setup_count",
    "expected_overdue_wos_peer_adjusted",
    "peer_adjusted_residual",
    "global_anomaly_score",
    "rank_raw_overdue",
    "rank_peer_adjusted",
    "rank_global_anomaly",
]
PEER_FIELDS = PEER_CATEGORICAL + PEER_FLAGS + PEER_NUMERIC

# FIXED VALUES — column-name patterns used by the detectors
ID_NAME_PATTERN = r"(?i)\b(id|identifier|asset|machine|equipment)\b"
DATE_NAME_PATTERN = r"(?i)(date|timestamp|time|scheduled|completed|created|updated)"

# FIXED VALUES — feature-group defaults and window parameters
DEFAULT_FEATURE_GROUPS = ["raw", "temporal", "statistical", "extra"]
TRAINING_FEATURE_GROUPS = ["raw", "temporal", "extra"]
DEFAULT_LAGS = [1, 3, 6]
DEFAULT_ROLLING = [3, 6, 12, 24]
DEFAULT_EWMA_SPAN = 6
MAX_INSPECT_ROWS = 5000
PREVIEW_ROWS = 10
SUPPORTED_TASKS = [
    "binary_failure_classification",
    "intervention_priority_classification",
    "time_series_analysis",
    "anomaly_detection_across_machines",
]

# Date formats tried, in order, by mixed-format parsing.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "yyyy-MM-dd HH:mm:ss.SSSSSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX",
    "yyyy-M-d",
    "M/d/yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "dd-MMM-yyyy",
]

# ---------------------------------------------------------------------------
# Serving tables (parquet, deterministic keys instead of autoincrement ids)
# ---------------------------------------------------------------------------
MACHINES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("machine_identifier", T.StringType(), False),
    T.StructField("machine_model", T.StringType(), True),
    T.StructField("equipment_category", T.StringType(), True),
    T.StructField("age", T.DoubleType(), True),
    T.StructField("dataset_id", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])
MODEL_VERSIONS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("version", T.StringType(), False),
    T.StructField("model_name", T.StringType(), False),
    T.StructField("model_type", T.StringType(), True),
    T.StructField("dataset_id", T.StringType(), True),
    T.StructField("threshold", T.DoubleType(), True),
    T.StructField("metrics_json", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("active", T.BooleanType(), False),
])
PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("machine_id", T.LongType(), False),
    T.StructField("model_version_id", T.StringType(), False),
    T.StructField("prediction_timestamp", T.TimestampNTZType(), True),
    T.StructField("failure_probability", T.DoubleType(), True),
    T.StructField("predicted_class", T.IntegerType(), True),
    T.StructField("intervention_priority", T.StringType(), True),
])
EXPLANATIONS_SCHEMA = T.StructType([
    T.StructField("prediction_id", T.LongType(), False),
    T.StructField("feature_name", T.StringType(), False),
    T.StructField("feature_value", T.DoubleType(), True),
    T.StructField("shap_value", T.DoubleType(), True),
    T.StructField("importance_rank", T.IntegerType(), False),
])
ALERTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("prediction_id", T.LongType(), False),
    T.StructField("machine_id", T.LongType(), False),
    T.StructField("intervention_priority", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("acknowledged_at", T.TimestampNTZType(), True),
    T.StructField("closed_at", T.TimestampNTZType(), True),
])
EXPERIMENT_RUNS_SCHEMA = T.StructType([
    T.StructField("experiment_id", T.StringType(), False),
    T.StructField("dataset", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("feature_group", T.StringType(), True),
    T.StructField("validation_strategy", T.StringType(), True),
    T.StructField("parameters_json", T.StringType(), True),
    T.StructField("metrics_json", T.StringType(), True),
    T.StructField("run_timestamp", T.TimestampNTZType(), True),
])
DATASETS_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("source_filename", T.StringType(), True),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("column_count", T.LongType(), True),
    T.StructField("machine_count", T.LongType(), True),
    T.StructField("status", T.StringType(), True),
])
MAPPINGS_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("field", T.StringType(), False),
    T.StructField("column_name", T.StringType(), True),
])
SERVING_TABLES = {
    "datasets": DATASETS_SCHEMA, "mappings": MAPPINGS_SCHEMA, "machines": MACHINES_SCHEMA, "model_versions": MODEL_VERSIONS_SCHEMA,
    "experiment_runs": EXPERIMENT_RUNS_SCHEMA, "predictions": PREDICTIONS_SCHEMA, "prediction_explanations": EXPLANATIONS_SCHEMA,
    "alerts": ALERTS_SCHEMA,
}
