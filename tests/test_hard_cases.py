"""Hard cases of the reference's own tests, re-expressed on small DataFrames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from upkeep.functions.columns import clean_text, to_double
from upkeep.operators import clean as C
from upkeep.operators import labels as L
from upkeep.operators import mapping as M
from upkeep.operators import metrics as E
from upkeep.operators import timeseries as W


def hours(n, start=dt.datetime(2025, 1, 1)):
    return [start + dt.timedelta(hours=i) for i in range(n)]


def horizon(spark, rows, h):
    df = spark.createDataFrame(rows, "machine_id string, timestamp timestamp_ntz, failure_label int, i int")
    out = L.horizon_label(df, h).orderBy("i")
    return [r["failure_within_horizon"] for r in out.collect()]


def test_horizon_window_before_failure(spark):
    rows = [("A", t, f, i) for i, (t, f) in enumerate(zip(hours(6), [0, 0, 0, 0, 1, 0]))]
    assert horizon(spark, rows, 2) == [0, 0, 1, 1, 0, 0]


def test_failure_row_is_not_its_own_positive(spark):
    rows = [("A", t, f, i) for i, (t, f) in enumerate(zip(hours(3), [0, 1, 0]))]
    assert horizon(spark, rows, 1)[1] == 0


def test_horizon_never_crosses_machines(spark):
    ts = hours(2)
    rows = [("A", ts[0], 0, 0), ("A", ts[1], 0, 1), ("B", ts[0], 0, 2), ("B", ts[1], 1, 3)]
    assert horizon(spark, rows, 2)[:2] == [0, 0]


def test_lag_is_null_at_each_machines_first_row(spark):
    rows = [(m, t, float(i)) for m in ("A", "B") for i, t in enumerate(hours(5))]
    df = spark.createDataFrame(rows, "machine_id string, timestamp timestamp_ntz, vibration double")
    out = W.lag_rolling(df, ["vibration"], lags=[1], windows=[])
    firsts = out.where(F.col("timestamp") == hours(1)[0]).select("vibration_lag_1").collect()
    assert [r[0] for r in firsts] == [None, None]


def test_sequence_windows_count(spark):
    rows = [(m, t, float(i), float(i) + off) for m, off in (("M1", 0), ("M2", 100)) for i, t in enumerate(hours(10))]
    df = spark.createDataFrame(rows, "machine_id string, timestamp timestamp_ntz, sensor_a double, sensor_b double")
    df = df.withColumn("y", F.lit(0))
    seq = W.sequence_windows(df, ["sensor_a", "sensor_b"], 4, "y")
    assert seq.count() == 14
    assert {r[0] for r in seq.select(F.size("seq")).collect()} == {4}


def test_duplicate_after_trimming(spark):
    df = spark.createDataFrame([(" M1 ", "Pump"), ("M1", "Pump"), ("M2", "Crusher")], "machine_id string, equipment_category string")
    deduped = C.dedupe(C.clean(df))
    assert deduped.count() == 2


def test_minmax_fitted_on_train_maps_outside_range(spark):
    train = spark.createDataFrame([(0.0,), (10.0,), (20.0,)], "downtime_minutes double")
    test = spark.createDataFrame([(100.0,)], "downtime_minutes double")
    params = C.fit_scaler(train, ["downtime_minutes"], "minmax")
    assert C.apply_scaler(test, params, ["downtime_minutes"]).first()[0] > 1.0


def test_standard_scaler_uses_population_std(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    out = C.apply_scaler(train, C.fit_scaler(train, ["x"]), ["x"]).orderBy("x").collect()
    assert [r[0] for r in out] == [-1.0, 1.0]


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7), (1, 0.9)], "y int, p double")
    r = E.ranking_metrics(df, []).first()
    assert r["roc_auc"] is None and r["pr_auc"] is None


def test_metric_vectors(spark):
    y, pred, proba = [0, 0, 1, 1, 1], [0, 1, 1, 1, 0], [0.1, 0.6, 0.7, 0.9, 0.4]
    df = spark.createDataFrame(list(zip(y, pred, proba)), "y int, pred int, p double")
    m = E.threshold_metrics(E.confusion(df, [], "y", "pred")).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (1, 1, 1, 2)
    assert m["accuracy"] == pytest.approx(0.6)
    assert m["precision"] == pytest.approx(2 / 3) and m["recall"] == pytest.approx(2 / 3)
    r = E.ranking_metrics(df, []).first()
    assert r["roc_auc"] == pytest.approx(5 / 6)
    assert r["pr_auc"] == pytest.approx((1 + 1 + 0.75) / 3)


def test_roc_curve_starts_at_origin_and_drops_collinear(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.3), (1, 0.9)], "y int, p double")
    pts = sorted((r["fpr"], r["tpr"]) for r in E.roc_curve(df, []).collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    assert (1 / 3, 1.0) not in pts  # collinear middle points dropped


def test_extra_name_sanitising():
    assert M.extra_names(["Weird Column!! (mm)"], set()) == [("Weird Column!! (mm)", "extra__weird_column_mm")]
    assert [n for _s, n in M.extra_names(["Cost (USD)", "Cost USD"], set())] == ["extra__cost_usd", "extra__cost_usd_2"]


def test_sentinel_becomes_null(spark):
    df = spark.createDataFrame([("A1", "0.5"), ("A2", "Not Applicable (area node)")], "`Asset ID` string, `Global Anomaly Score` string")
    mapped = M.apply_mapping(df, M.suggest_mapping(df.columns), "t")
    vals = [r[0] for r in mapped.orderBy("machine_id").select("global_anomaly_score").collect()]
    assert vals == [0.5, None]


def test_mixed_serial_numbers_stay_text(spark):
    df = spark.createDataFrame([("A1", "SN-001"), ("A2", "4021"), ("A3", None)], "`Asset ID` string, `Serial Number` string")
    typed = M.type_extras(M.apply_mapping(df, M.suggest_mapping(df.columns), "t"))
    assert dict(typed.dtypes)["extra__serial_number"] == "string"
    assert typed.where(F.col("extra__serial_number").isNull()).count() == 1


def test_required_field_missing_raises(spark):
    df = spark.createDataFrame([("x",)], "`Equip No` string")
    with pytest.raises(ValueError):
        M.apply_mapping(df, M.suggest_mapping(df.columns), "t")


def test_suggest_mapping_dictionary_order():
    m = M.suggest_mapping(["Asset ID", "Equipment Category", "Overdue PMs", "Overdue WOs", "Last Completed PM",
                           "Irrelevant Notes"])
    assert m["machine_id"] == "Asset ID" and m["equipment_category"] == "Equipment Category"
    assert m["overdue_pms"] == "Overdue PMs" and m["last_completed_pm"] == "Last Completed PM"
    assert m["manufacturer"] is None


def test_clean_text_and_numeric_guard(spark):
    df = spark.createDataFrame([("\t a ", "5d"), ("nan", " 3 "), ("None", "1e3")], "t string, n string")
    out = df.select(clean_text("t").alias("t"), to_double(F.col("n")).alias("n")).collect()
    assert [r["t"] for r in out] == ["a", None, None]
    assert [r["n"] for r in out] == [None, 3.0, 1000.0]


def test_thresholds_inclusive_and_ordered(spark):
    df = spark.createDataFrame([(0.1,), (0.6,), (0.9,)], "priority_score double")
    th = spark.createDataFrame([(0.5, 0.9)], "watch_threshold double, high_threshold double")
    out = [r[0] for r in L.apply_thresholds(df, th).orderBy("priority_score").select("intervention_priority").collect()]
    assert out == ["Normal", "Watch", "High Priority"]
    with pytest.raises(ValueError):
        L.fit_thresholds(df, watch_pct=90, high_pct=70)


def test_priority_score_constant_column_counts_in_denominator(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "overdue_pms double, overdue_wos double")
    s = L.priority_score(df, {"overdue_pms": 1.0, "overdue_wos": 1.0}).orderBy("overdue_pms").collect()
    assert [r["priority_score"] for r in s] == [0.0, 0.5]


def test_signal_requires_variance(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    res = {r["column_name"]: r["has_signal"] for r in L.signal_test(df, ["a", "b"]).collect()}
    assert res == {"a": False, "b": True}


def test_append_unique_is_lazy_and_rejects_duplicates(spark):
    from upkeep.operators.serving import append_unique

    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ok = append_unique(table, spark.createDataFrame([("c", 3)], "id string, v int"), "id")
    assert sorted(r["id"] for r in ok.collect()) == ["a", "b", "c"]
    bad = append_unique(table, spark.createDataFrame([("b", 9), ("d", 4)], "id string, v int"), "id")
    with pytest.raises(Exception, match="duplicate id: b"):
        bad.collect()


def test_exact_percentiles_skewed_multi_column(spark):
    from pyspark.sql import functions as F

    from upkeep.operators.positions import exact_percentiles

    rows = [(7.0 if i % 3 == 0 else float((i * 37) % 51), None if i % 5 == 0 else ((i * 7919) % 1000) / 997.0)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = [[f"{c}{j}" for j in range(len(probs))] for c in "ab"]
    got = exact_percentiles(df, ["a", "b"], probs, names).first()
    ref = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in "ab"]).first()
    for ci, c in enumerate("ab"):
        for j in range(len(probs)):
            assert got[names[ci][j]] == pytest.approx(ref[c][j], abs=1e-12)
    assert exact_percentiles(df.where("a < 0"), ["a"], [0.5], [["m"]]).first()["m"] is None
