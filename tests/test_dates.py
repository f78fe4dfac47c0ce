"""Mixed dates: one rule per shape, equal to pandas; failures by shape."""

import datetime

import pandas as pd

from upkeep.functions.columns import date_failures, parse_mixed

TEXTS = ["20250604", "4 June 2025", "2025/6/4", "06/04/2025 10:00", "2025-06-04T10:00", "Jun 4 2025", "6/4/2025 10:00:00", "2025-06-04", "2025-06-04 10:11:12",
         "2025-06-04 10:11:12.123456789", "June 4, 2025", "04-Jun-2025", "2025/06/04 10:11:12", "2025-06-04T10:11:12.5", "20250604 10:11", "sep 9, 2024",
         "2024-02-29", " 2025-06-04\t"]
BAD = ["2025-02-29", "13/13/2025", "abc", "2025-06-04 25:00", "Foo 4 2025", "5d", "2025", "12", "", "2025-06-04 10:00 pm?", "99999999"]


def test_texts_parse_as_in_pandas(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", parse_mixed("t").alias("d")).collect()}
    for t in TEXTS:
        assert got[t] == pd.to_datetime(t.strip()).to_pydatetime(warn=False), t


def test_day_first_with_points_offsets_and_no_dates(spark):
    df = spark.createDataFrame([(t,) for t in ["04.06.2025", "2025-06-04 10:00:00+02:00", "2025-06-04T10:00:00Z", "2025-06-04T10:00:00.25-0330", None, *BAD]], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", parse_mixed("t").alias("d")).collect()}
    at = datetime.datetime(2025, 6, 4)
    assert got["04.06.2025"] == at and got["2025-06-04 10:00:00+02:00"] == at.replace(hour=8) and got["2025-06-04T10:00:00Z"] == at.replace(hour=10)
    assert got["2025-06-04T10:00:00.25-0330"] == at.replace(hour=13, minute=30, microsecond=250000) and got[None] is None
    assert all(got[t] is None for t in BAD)


def test_failures_by_shape(spark):
    df = spark.createDataFrame([("5d", "2025-06-04"), ("7d", "x y"), ("2025-13-01", None), ("  ", "n/a")], "a string, `b.c` string")
    rows = {(r["column_name"], r["mask"]): (r["n"], r["example"]) for r in date_failures(df, ["a", "b.c"]).collect()}
    assert rows == {("a", "9a"): (2, "5d"), ("a", "9999-99-99"): (1, "2025-13-01"), ("b.c", "a a"): (1, "x y"), ("b.c", "a/a"): (1, "n/a")}
