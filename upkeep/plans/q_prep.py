"""Queries for profiling (P), mapping (M) and cleaning (C) on the raw export."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from upkeep.functions.columns import r6
from upkeep.operators import clean as C
from upkeep.operators import mapping as M
from upkeep.operators import profile as P
from upkeep.plans import sqlfrag as S
from upkeep.plans.bindings import EXPECTED_EXTRAS, clean_export, standard_export, typed_export
from upkeep.plans.oracle import with_ctes
from upkeep.plans.registry import query
from upkeep.schema import COMPLIANCE_FIELDS, DATE_NAME_PATTERN, FIELD_DICTIONARY, ID_NAME_PATTERN, TEXT_FIELDS
from upkeep.sources.testdata import RAW_EXPORT_COLUMNS, asset_snapshot, raw_export, table

RAW = RAW_EXPORT_COLUMNS


def _agg_class(x: str) -> str:
    return (f"CASE WHEN count({x}) = 0 THEN 'empty' WHEN count({S.to_double(x)}) = count({x}) THEN 'numeric' "
            f"WHEN count({S.parse_ts(x)}) = count({x}) THEN 'datetime' ELSE 'text' END")


def _is_num(x: str) -> str:
    return f"(count({x}) > 0 AND count({S.to_double(x)}) = count({x}))"


# ------------------------------------------------------------------ P1
def _profile_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = S.q(c)
        smallest = (f"(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT {x} AS v FROM {src} "
                    f"WHERE {x} IS NOT NULL ORDER BY v LIMIT 3))")
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS ordinal, {_agg_class(x)} AS dtype, "
            f"CAST(count(*) - count({x}) AS BIGINT) AS missing_count, "
            f"CASE WHEN count(*) > 0 THEN round(CAST(count(*) - count({x}) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 2) "
            f"ELSE 0.0 END AS missing_pct, "
            f"{smallest}[1] AS sample_1, {smallest}[2] AS sample_2, {smallest}[3] AS sample_3 FROM {src}"
        )
    return "\nUNION ALL\n".join(parts)


@query("column_profile", with_ctes(["raw_export"], _profile_sql("raw_export", RAW)))
def column_profile(spark, d):
    return P.column_profile(raw_export(spark, d))


# ------------------------------------------------------------------ P2
@query("infer_dtypes", with_ctes(["raw_export"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {i} AS ordinal, {_agg_class(S.q(c))} AS dtype FROM raw_export"
    for i, c in enumerate(RAW))))
def infer_dtypes(spark, d):
    return P.infer_dtypes(raw_export(spark, d))


# ------------------------------------------------------------------ P3
@query("duplicate_count", with_ctes(["raw_export"], """
SELECT n_rows, n_distinct, n_rows - n_distinct AS n_duplicates
FROM (SELECT count(*) AS n_rows FROM raw_export),
     (SELECT count(*) AS n_distinct FROM (SELECT DISTINCT * FROM raw_export))
"""))
def duplicate_count(spark, d):
    return P.duplicate_count(raw_export(spark, d))


# ------------------------------------------------------------------ P4
@query("preview_topn", with_ctes(["asset_snapshot"], "SELECT * FROM asset_snapshot ORDER BY machine_id LIMIT 10"))
def preview_topn(spark, d):
    return P.preview(asset_snapshot(spark, d), ["machine_id"])


# ------------------------------------------------------------------ P5
@query("missingness", with_ctes(["raw_export"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, coalesce(round(avg(CASE WHEN {S.q(c)} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) * 100, 2), 0.0) "
    f"AS missing_pct FROM raw_export" for c in RAW)))
def missingness(spark, d):
    return P.missingness(raw_export(spark, d))


# ------------------------------------------------------------------ P6
def _dt_sql(c: str) -> str:
    x = S.q(c)
    name_hit = "TRUE" if re.search(DATE_NAME_PATTERN, c) else "FALSE"
    return (f"SELECT '{c}' AS column_name, CASE WHEN {_is_num(x)} THEN FALSE WHEN count({x}) = 0 THEN FALSE "
            f"WHEN {name_hit} THEN TRUE ELSE CAST(count({S.parse_ts(x)}) AS DOUBLE) / count({x}) > 0.8 END "
            f"AS is_datetime FROM raw_export")


@query("detect_datetime", with_ctes(["raw_export"], "\nUNION ALL\n".join(_dt_sql(c) for c in RAW)))
def detect_datetime(spark, d):
    return P.detect_datetime(typed_export(spark, d))


# ------------------------------------------------------------------ P7
def _id_sql(c: str) -> str:
    x = S.q(c)
    name_hit = "TRUE" if re.search(ID_NAME_PATTERN, c) else "FALSE"
    top = f"(SELECT max(cnt) FROM (SELECT count(*) AS cnt FROM raw_export WHERE {x} IS NOT NULL GROUP BY {x}))"
    return (f"SELECT '{c}' AS column_name, ({name_hit} OR coalesce(NOT {_is_num(x)} AND count(DISTINCT {x}) > 1 "
            f"AND count(DISTINCT {x}) < count(*) AND CAST({top} AS DOUBLE) / count(*) < 0.9, FALSE)) AS is_id_like "
            f"FROM raw_export")


@query("detect_id_like", with_ctes(["raw_export"], "\nUNION ALL\n".join(_id_sql(c) for c in RAW)))
def detect_id_like(spark, d):
    return P.detect_id_like(typed_export(spark, d))


# ------------------------------------------------------------------ M3
_ALL_STD = [f[0] for f in FIELD_DICTIONARY] + ["source_dataset"] + [n for _s, n in EXPECTED_EXTRAS]


@query("apply_mapping", with_ctes(["standard_export"], "SELECT * FROM standard_export"))
def apply_mapping(spark, d):
    return standard_export(spark, d)


# ------------------------------------------------------------------ M4
@query("extra_passthrough", with_ctes(["standard_export"],
       "SELECT " + ", ".join(n for _s, n in EXPECTED_EXTRAS) + " FROM standard_export"))
def extra_passthrough(spark, d):
    s = standard_export(spark, d)
    return s.select(*[c for c in s.columns if c.startswith("extra__")])


# ------------------------------------------------------------------ M5
@query("sentinel_coercion", with_ctes(["standard_export"],
       "SELECT machine_id, global_anomaly_score FROM standard_export"))
def sentinel_coercion(spark, d):
    return standard_export(spark, d).select("machine_id", "global_anomaly_score")


# ------------------------------------------------------------------ M6
@query("mixed_type_to_string", with_ctes(["raw_export"],
       f'SELECT "Serial Number" AS serial_number, {S.to_double(S.q("Spare Parts Count"))} AS spare_parts_count '
       f"FROM raw_export"))
def mixed_type_to_string(spark, d):
    t = typed_export(spark, d)
    return t.select(F.col("`Serial Number`").alias("serial_number"), F.col("`Spare Parts Count`").alias("spare_parts_count"))


# ------------------------------------------------------------------ M8
@query("drop_null_key", with_ctes(["clean_export"],
       "SELECT machine_id, equipment_category FROM clean_export WHERE machine_id IS NOT NULL"))
def drop_null_key(spark, d):
    return M.drop_null_key(clean_export(spark, d)).select("machine_id", "equipment_category")


# ------------------------------------------------------------------ C1-C3
@query("clean_text", with_ctes(["clean_export"], "SELECT " + ", ".join(TEXT_FIELDS) + " FROM clean_export"))
def clean_text(spark, d):
    return clean_export(spark, d).select(*TEXT_FIELDS)


@query("coerce_numeric", with_ctes(["clean_export"], "SELECT " + ", ".join(COMPLIANCE_FIELDS) + " FROM clean_export"))
def coerce_numeric(spark, d):
    return clean_export(spark, d).select(*COMPLIANCE_FIELDS)


@query("parse_dates", with_ctes(["clean_export"],
       "SELECT machine_id, last_completed_pm, last_completed_wo FROM clean_export"))
def parse_dates(spark, d):
    return clean_export(spark, d).select("machine_id", "last_completed_pm", "last_completed_wo")


# ------------------------------------------------------------------ C4
@query("dedupe_rows", with_ctes(["clean_export"], """
SELECT rows_before, rows_after, rows_before - rows_after AS n_dropped
FROM (SELECT count(*) AS rows_before FROM clean_export),
     (SELECT count(*) AS rows_after FROM (SELECT DISTINCT * FROM clean_export))
"""))
def dedupe_rows(spark, d):
    ce = clean_export(spark, d)
    before = ce.agg(F.count(F.lit(1)).alias("rows_before"))
    after = C.dedupe(ce).agg(F.count(F.lit(1)).alias("rows_after"))
    return before.crossJoin(after).withColumn("n_dropped", F.col("rows_before") - F.col("rows_after"))


# ------------------------------------------------------------------ C5
_FILL_SQL = ("SELECT machine_id, " + ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in TEXT_FIELDS[1:]) + ", "
             + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in COMPLIANCE_FIELDS)
             + ", last_completed_pm, last_completed_wo FROM (SELECT DISTINCT * FROM clean_export)")


@query("fill_missing", with_ctes(["clean_export"], _FILL_SQL))
def fill_missing(spark, d):
    f = C.fill_missing(C.dedupe(clean_export(spark, d)))
    return f.select(*TEXT_FIELDS, *COMPLIANCE_FIELDS, "last_completed_pm", "last_completed_wo")


# ------------------------------------------------------------------ C6 / C7 on lineitem
LI_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
_FENCES = ", ".join(
    f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
    f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
    for c in LI_COLS
)
_FLAGS = ", ".join(f"({c} IS NOT NULL AND ({c} < lo_{c} OR {c} > hi_{c})) AS {c}_outlier" for c in LI_COLS)


@query("iqr_outlier_flags", f"WITH b AS (SELECT {_FENCES} FROM lineitem) "
       f"SELECT l_orderkey, l_linenumber, {_FLAGS} FROM lineitem, b")
def iqr_outlier_flags(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LI_COLS)
    return C.iqr_outlier_flags(li, LI_COLS).drop(*LI_COLS)


@query("iqr_outlier_counts", f"WITH b AS (SELECT {_FENCES} FROM lineitem), f AS (SELECT {_FLAGS} FROM lineitem, b) "
       + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if({c}_outlier) AS n_outliers FROM f" for c in LI_COLS))
def iqr_outlier_counts(spark, d):
    li = table(spark, d, "lineitem").select(*LI_COLS)
    return C.iqr_outlier_counts(li, LI_COLS)


# ------------------------------------------------------------------ C8 (fit on rows shipped before 1997)
_TRAIN = "l_shipdate < TIMESTAMP '1997-01-01 00:00:00'"


def _scale_sql(method: str) -> str:
    if method == "standard":
        fit = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in LI_COLS)
    else:
        fit = ", ".join(f"min({c}) AS a_{c}, max({c}) - min({c}) AS b_{c}" for c in LI_COLS)
    sel = ", ".join(
        f"round(({c} - a_{c}) / (CASE WHEN b_{c} = 0 THEN 1.0 ELSE b_{c} END), 6) AS {c}" for c in LI_COLS)
    return f"WITH p AS (SELECT {fit} FROM lineitem WHERE {_TRAIN}) SELECT l_orderkey, l_linenumber, {sel} FROM lineitem, p"


def _scale(spark, d, method):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *LI_COLS)
    train = li.where(F.col("l_shipdate") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    params = C.fit_scaler(train, LI_COLS, method)
    out = C.apply_scaler(li, params, LI_COLS)
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in LI_COLS])


@query("scale_standard", _scale_sql("standard"))
def scale_standard(spark, d):
    return _scale(spark, d, "standard")


@query("scale_minmax", _scale_sql("minmax"))
def scale_minmax(spark, d):
    return _scale(spark, d, "minmax")


# ------------------------------------------------------------------ C9
def _report_sql() -> str:
    std_cols = _ALL_STD
    miss = lambda src, c: (
        f"coalesce(round(avg(CASE WHEN {S.q(c)} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) * 100, 2), 0.0)")
    parts = [
        "SELECT 'rows' AS section, 'rows_before' AS item, CAST(count(*) AS DOUBLE) AS value FROM standard_export",
        "SELECT 'rows', 'rows_after', CAST(count(*) AS DOUBLE) FROM dd",
        "SELECT 'rows', 'duplicates_dropped', CAST((SELECT count(*) FROM clean_export) - (SELECT count(*) FROM dd) AS DOUBLE)",
    ]
    parts += [f"SELECT 'missing_before', '{c}', {miss('standard_export', c)} FROM standard_export" for c in std_cols]
    parts += [f"SELECT 'missing_after', '{c}', {miss('filled', c)} FROM filled" for c in std_cols]
    fences = ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in COMPLIANCE_FIELDS)
    parts += [
        f"SELECT 'outliers', '{c}', CAST(count_if({c} IS NOT NULL AND ({c} < lo_{c} OR {c} > hi_{c})) AS DOUBLE) "
        f"FROM dd, (SELECT {fences} FROM dd)" for c in COMPLIANCE_FIELDS
    ]
    fill_sel = []
    for c in std_cols:
        if c in COMPLIANCE_FIELDS:
            fill_sel.append(f"coalesce({c}, 0.0) AS {c}")
        elif c in TEXT_FIELDS and c != "machine_id":
            fill_sel.append(f"coalesce({c}, 'Unknown') AS {c}")
        else:
            fill_sel.append(S.q(c))
    extra = [("dd", "SELECT DISTINCT * FROM clean_export"), ("filled", "SELECT " + ", ".join(fill_sel) + " FROM dd")]
    return with_ctes(["clean_export"], "\nUNION ALL\n".join(parts), extra)


@query("preprocess_report", _report_sql())
def preprocess_report(spark, d):
    _filled, report = C.preprocess(standard_export(spark, d))
    return report
