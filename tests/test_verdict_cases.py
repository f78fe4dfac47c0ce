"""Inputs on which earlier versions of the operators gave wrong rows."""

import math

import pandas as pd
import pytest

from upkeep.functions.columns import parse_timestamp
from upkeep.operators import labels, splits, timeseries
from upkeep.session import checkpoint_dir
from upkeep.sources import files


def test_ewma_of_a_sparse_sensor_equals_pandas(spark):
    values = [float(i) if i % 10 == 0 else None for i in range(500)]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(values)] + [("B", 0, 2.0), ("B", 1, None)], "machine_id string, timestamp long, vibration double")
    got = timeseries.trend(df, ["vibration"], span=24).toPandas().sort_values(["machine_id", "timestamp"])
    want = pd.Series(values).ewm(span=24, adjust=False).mean()
    own = got[got.machine_id == "A"]["vibration_ewma_24"].to_numpy()
    assert max(abs(a - b) for a, b in zip(own, want, strict=True) if not (math.isnan(a) and math.isnan(b))) < 1e-9
    assert got[got.machine_id == "B"]["vibration_ewma_24"].tolist() == [2.0, 2.0]


def test_horizon_label_counts_the_end_but_not_the_row_itself(spark):
    rows = [("A", f"2024-01-01 0{h}:00:00", int(h == 4)) for h in range(7)]
    df = spark.createDataFrame(rows, "machine_id string, t string, failure_label int").selectExpr("machine_id", "cast(t as timestamp_ntz) as timestamp", "failure_label")
    got = labels.horizon_label(df, 2).orderBy("timestamp").toPandas()["failure_within_horizon"].tolist()
    assert got == [0, 0, 1, 1, 0, 0, 0]


def test_csv_keeps_quotes_and_line_breaks_and_reports_ragged_rows(spark, tmp_path):
    df = spark.createDataFrame([('said "hi", then left', "1"), ("line one\nline two", "2")], "note string, n string")
    back = files.read_csv(spark, files.write_csv(df, str(tmp_path / "a")), multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "b.csv").write_text("a,n\nx,1\ny\nz,3,4\nw,five\n")
    report = files.bad_record_report(spark, str(tmp_path / "b.csv"), files.T.StructType([files.T.StructField("a", files.T.StringType()), files.T.StructField("n", files.T.LongType())]))
    assert tuple(report.first()) == (4, 3)


def test_both_layouts_of_metrics(spark, tmp_path):
    (tmp_path / "exp").mkdir()
    (tmp_path / "exp" / "forest_metrics.json").write_text('{"accuracy": 0.5}')
    rows = {r["metric"]: r["value"] for r in files.metrics_long(spark, str(tmp_path)).collect()}
    assert rows["accuracy"] == 0.5 and rows["recall"] is None and len(rows) == 6


@pytest.mark.parametrize("text", ["6/4/2025", "2025-6-4", "2025-06-04 10:00:00.123", "2025-06-04T10:00:00Z", "2025-06-04T10:00:00.5",
                                  "2025-06-04T10:00:00+00:00", "June 4, 2025", "04-Jun-2025"])
def test_mixed_dates(spark, text):
    got = spark.createDataFrame([(text,)], "d string").select(parse_timestamp("d").alias("d")).first()["d"]
    assert got is not None and pd.Timestamp(got).date() == pd.Timestamp("2025-06-04").date()


def test_rows_without_stratum_or_machine_stay(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2], None if i % 5 == 0 else f"m{i % 7}") for i in range(100)], "k int, s string, machine_id string")
    one = splits.split_stratified(df, "s", "k")
    assert one.count() == 100 and one.where("split IS NULL").isEmpty()
    two = splits.split_holdout(df)
    assert two.count() == 100 and two.where("split IS NULL").isEmpty()


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_registered_inspection_covers_the_whole_table(spark, monkeypatch):
    from upkeep.plans import q_sources
    from upkeep.plans.registry import QUERIES

    columns = q_sources.RAW_EXPORT_COLUMNS
    rows = [(None if i < 5500 else str(i), *(["x"] * (len(columns) - 1))) for i in range(6000)]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    monkeypatch.setattr(q_sources, "raw_export", lambda s, d: raw)
    got = {r["column_name"]: r for r in QUERIES["inspect_bounded"](spark, "").collect()}
    first = got[columns[0]]
    assert (first["missing_count"], first["n_rows"], first["n_distinct"], first["n_duplicates"], first["dtype"]) == (5500, 6000, 501, 5499, "numeric")
    assert first["preview"] == [None] * 10 and got[columns[1]]["preview"] == ["x"] * 10 and len(got) == len(columns)
