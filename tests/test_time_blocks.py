"""EWMA on blocks of time, lags as a feature group, names with dots."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from upkeep.operators import features, profile, timeseries


def spread_frames(spark, rows, blocks):
    spark.conf.set("spark.sql.shuffle.partitions", str(blocks))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return spark.createDataFrame(rows, "machine_id string, timestamp long, a double, b double")


@pytest.fixture
def settings(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled"]
    kept = {n: spark.conf.get(n) for n in names}
    yield
    for n, v in kept.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("blocks", [1, 9])
def test_ewma_of_a_hot_machine_equals_pandas(spark, settings, blocks):
    rng = np.random.default_rng(4)
    rows = [("hot", i, float(rng.normal()) if rng.random() < 0.7 else None, float(i) if 900 < i < 905 else None) for i in range(2000)]
    rows += [(m, i, float(rng.normal()), None if i < 3 else 1.0) for m in ("cold", "zz", None) for i in range(6)]
    df = spread_frames(spark, rows, blocks)
    out = timeseries.ewma(df, ["a", "b"], 6, "machine_id", "timestamp")
    if blocks > 1:  # one machine's rows are on many tasks
        assert out.where("machine_id = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 4
    got = out.toPandas()
    for m in ("hot", "cold", "zz", None):
        own = got[got.machine_id.isna() if m is None else got.machine_id == m].sort_values("timestamp")
        for s in ("a", "b"):
            want = pd.Series([r[2 if s == "a" else 3] for r in rows if r[0] == m], dtype=float).ewm(span=6, adjust=False).mean()
            np.testing.assert_allclose(own[f"{s}_ewma_6"].to_numpy(float), want.to_numpy(), rtol=1e-12, atol=1e-12)


def test_ewma_across_blocks_without_values(spark, settings):
    rows = [("m", i, 5.0 if i == 3 else 8.0 if i == 900 else None, None) for i in range(1000)] + [("n", 1, None, None), ("n", 2, 7.0, None)]
    got = timeseries.ewma(spread_frames(spark, rows, 7), ["a"], 4, "machine_id", "timestamp").toPandas().sort_values(["machine_id", "timestamp"])
    want = pd.Series([r[2] for r in rows[:1000]], dtype=float).ewm(span=4, adjust=False).mean()
    np.testing.assert_allclose(got[got.machine_id == "m"]["a_ewma_4"].to_numpy(float), want.to_numpy(), rtol=1e-12)
    tail = got[got.machine_id == "n"]["a_ewma_4"].tolist()
    assert np.isnan(tail[0]) and tail[1] == 7.0
    assert timeseries.ewma(spread_frames(spark, rows, 3).limit(0), ["a"], 4, "machine_id", "timestamp").count() == 0


def test_differences_need_no_python(spark):
    df = spark.createDataFrame([("A", 1, 2.0), ("A", 2, 3.0)], "machine_id string, timestamp long, vibration double")
    part = timeseries.trend(df, parts=("diff", "pct_change"))
    assert part.columns[-2:] == ["vibration_diff_1", "vibration_pct_change_1"]
    assert "Arrow" not in part._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="Unknown trend"):
        timeseries.trend(df, parts=("slope",))


def test_lags_are_a_feature_group(spark):
    df = spark.createDataFrame([("A", 1, 2.0), ("A", 2, 3.0), ("B", 1, 9.0)], "machine_id string, timestamp long, vibration double")
    out = df.select("machine_id", "timestamp", *features.feature_columns(df, ["lags"]))
    assert {"vibration_lag_1", "vibration_rolling_mean_3", "vibration_rolling_std_24"} <= set(out.columns)
    assert {(r["machine_id"], r["timestamp"]): r["vibration_lag_1"] for r in out.collect()} == {("A", 1): None, ("A", 2): 2.0, ("B", 1): None}
    assert features.feature_columns(df.drop("timestamp"), ["lags"]) == []


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "x"), (3.0, None)], "`Cost (U.S.)` double, `a.b` string")
    assert {tuple(r) for r in profile.missingness(df).collect()} == {("Cost (U.S.)", 33.33), ("a.b", 33.33)}
    assert {r["column_name"] for r in profile.column_profile(df).collect()} == set(df.columns)
    assert {r["column_name"] for r in profile.detect_id_like(df).collect()} == set(df.columns)
    assert profile.duplicate_count(df).count() == 1
