"""Derived bindings built with the library's own operators (Spark side) and
their oracle CTEs (DuckDB side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from upkeep.operators.clean import clean
from upkeep.operators.clean import preprocess
from upkeep.operators.mapping import apply_mapping, drop_null_key, suggest_mapping, type_extras
from upkeep.operators.profile import type_by_inference
from upkeep.plans import sqlfrag as S
from upkeep.plans.oracle import register
from upkeep.schema import COMPLIANCE_FIELDS, DATE_FIELDS, FIELD_DICTIONARY, TEXT_FIELDS
from upkeep.sources.testdata import raw_export


def standard_export(spark: SparkSession, d: str) -> DataFrame:
    raw = raw_export(spark, d)
    return type_extras(apply_mapping(raw, suggest_mapping(raw.columns), "raw_export"))


def processed_export(spark: SparkSession, d: str) -> DataFrame:
    """Import path: mapped → rows without key dropped → preprocessed (filled)."""
    filled, _report = preprocess(drop_null_key(standard_export(spark, d)))
    return filled


def standard_telemetry(spark: SparkSession, d: str) -> DataFrame:
    from upkeep.sources.testdata import telemetry

    tel = telemetry(spark, d)
    return type_extras(apply_mapping(tel, suggest_mapping(tel.columns), "telemetry"))


def clean_export(spark: SparkSession, d: str) -> DataFrame:
    return clean(standard_export(spark, d))


def typed_export(spark: SparkSession, d: str) -> DataFrame:
    return type_by_inference(raw_export(spark, d))


# ---------------------------------------------------------------- oracle side
# Expected outcome of the alias matching on the raw export's header, written
# out independently of ``suggest_mapping`` so the oracle checks it.
EXPECTED_MAPPING = {
    "machine_id": "Asset ID",
    "equipment_category": "Equipment Category",
    "manufacturer": "Manufacturer",
    "criticality": "Criticality",
    "overdue_pms": "Overdue PMs",
    "overdue_wos": "Overdue WOs",
    "total_completed_pms": "Total Completed PMs",
    "total_completed_wos": "Total Completed WOs",
    "downtime_minutes": "Downtime (min)",
    "total_cost": "Total Cost",
    "last_completed_pm": "Last Completed PM",
    "last_completed_wo": "Last Completed WO",
    "global_anomaly_score": "Global Anomaly Score",
}
EXPECTED_EXTRAS = [
    ("Serial Number", "extra__serial_number"),
    ("Spare Parts Count", "extra__spare_parts_count"),
    ("Irrelevant Notes", "extra__irrelevant_notes"),
]
EXPECTED_NUMERIC_EXTRAS = {"extra__spare_parts_count"}
TELEMETRY_MAPPING = {
    "machine_id": "machine_id",
    "failure_label": "failure_label",
    "timestamp": "timestamp",
    "pressure": "pressure",
    "vibration": "vibration",
}


def _standard_sql(mapping=None, extras=None, numeric_extras=None, src_table="raw_export",
                  dataset="raw_export", typed=False) -> str:
    mapping = EXPECTED_MAPPING if mapping is None else mapping
    extras = EXPECTED_EXTRAS if extras is None else extras
    numeric_extras = EXPECTED_NUMERIC_EXTRAS if numeric_extras is None else numeric_extras
    sel = []
    for field, _r, _a, numeric in FIELD_DICTIONARY:
        src = mapping.get(field)
        if src is None:
            sel.append(f"CAST(NULL AS {'DOUBLE' if numeric else 'VARCHAR'}) AS {S.q(field)}")
        elif numeric and not typed:
            sel.append(f"{S.to_double(S.q(src))} AS {S.q(field)}")
        else:
            sel.append(f"{S.q(src)} AS {S.q(field)}")
    sel.append(f"'{dataset}' AS source_dataset")
    for src, name in extras:
        x = S.q(src)
        sel.append(f"{S.to_double(x) if name in numeric_extras and not typed else x} AS {name}")
    return "SELECT " + ",\n  ".join(sel) + f"\nFROM {src_table}"


def _clean_sql(src: str = "standard_export") -> str:
    sel = []
    for field, *_ in FIELD_DICTIONARY:
        f = S.q(field)
        if field in TEXT_FIELDS:
            sel.append(f"{S.clean_text(f)} AS {f}")
        elif field in COMPLIANCE_FIELDS:
            sel.append(f"{S.to_double(f)} AS {f}")
        elif field in DATE_FIELDS:
            sel.append(f"{S.parse_ts(f)} AS {f}")
        else:
            sel.append(f)
    sel.append("source_dataset")
    sel += [name for _s, name in EXPECTED_EXTRAS]
    return "SELECT " + ",\n  ".join(sel) + f"\nFROM {src}"


def _fill_sql(src: str) -> str:
    cols = [f[0] for f in FIELD_DICTIONARY] + ["source_dataset"] + [n for _s, n in EXPECTED_EXTRAS]
    sel = []
    for c in cols:
        if c in COMPLIANCE_FIELDS:
            sel.append(f"coalesce({c}, 0.0) AS {c}")
        elif c in TEXT_FIELDS and c != "machine_id":
            sel.append(f"coalesce({c}, 'Unknown') AS {c}")
        else:
            sel.append(S.q(c))
    return "SELECT " + ", ".join(sel) + f" FROM {src}"


register("standard_export", _standard_sql(), ["raw_export"])
register("clean_export", _clean_sql(), ["standard_export"])
register("std_keyed", "SELECT * FROM standard_export WHERE machine_id IS NOT NULL", ["standard_export"])
register("clean_keyed", _clean_sql("std_keyed"), ["std_keyed"])
register("dedup_keyed", "SELECT DISTINCT * FROM clean_keyed", ["clean_keyed"])
register("processed_export", _fill_sql("dedup_keyed"), ["dedup_keyed"])
register("standard_telemetry", _standard_sql(TELEMETRY_MAPPING, [("event_id", "extra__event_id")], set(),
                                             "telemetry", "telemetry", typed=True), ["telemetry"])
