"""CSV records with quoted line breaks cut by many tasks; category tables; mapping and
feature registry."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.operators import features as X
from upkeep.operators import mapping as M
from upkeep.sources import csv_records
from upkeep.sources import files as FS

OPTIONS = {"header": "true", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "256b", "spark.sql.files.openCostInBytes": "1b"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def _write(folder, texts):
    os.makedirs(folder, exist_ok=True)
    for i, text in enumerate(texts):
        with open(f"{folder}/f{i}.csv", "w", newline="") as f:
            f.write(text)
    return str(folder)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_multi_line_reader(spark, tmp_path, small_splits, end):
    rng = random.Random(7)
    pieces = ["a", "b c", '""', ",", "\n", "x" * 30, "\n\n", "é", "\n" * 90, "y,z"]

    def field():
        kind = rng.random()
        if kind < 0.4:
            return '"' + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))).replace("\n", end) + '"'
        return rng.choice(["", "plain", '5" pipe', " led", "k" * 50])

    texts = ["id,one,two" + end + "".join(f"{i},{field()},{field()}" + end for i in range(60)) for _ in range(3)]
    texts.append('id,"on\ne",two'.replace("\n", end) + end + '1,"a' + end + 'b",2')  # header over two lines, no last line end
    texts.append("id,one,two" + end)
    path = _write(tmp_path / "c.csv", texts)
    splits = csv_records.split_summaries(spark, path)
    assert splits.count() > 25 and splits.where("opens").count() > 5
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "one", "two")])
    want = _rows(spark.read.options(**OPTIONS).schema(schema).csv(path))
    assert len(want) == 181
    got = FS.read_csv(spark, path, schema)
    # breaks are kept as they are in the file; the multi-line reader turns CR LF into LF
    assert _rows(got.select("id", *[F.regexp_replace(c, "\r\n", "\n").alias(c) for c in ("one", "two")])) == want
    assert end == "\n" or got.where(F.col("one").contains("\r\n")).count() > 5
    report = FS.bad_record_report(spark, path, T.StructType([T.StructField("id", T.LongType()), *schema.fields[1:]])).first()
    assert (report["n_rows"], report["n_bad_rows"]) == (181, 0)


def test_own_files_with_line_breaks_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", None), (2, 'say "x",\n\ny', "z"), (3, "", "q")], "id int, t string, u string")
    path = FS.write_csv(df, str(tmp_path / "own.csv"), null_value=FS.NULL_MARKER)
    back = FS.read_csv(spark, path, df.schema, null_value=FS.NULL_MARKER)
    assert _rows(back) == _rows(df)


def test_bad_records_with_line_breaks(spark, tmp_path):
    path = _write(tmp_path / "b.csv", ['id,t\n1,"a\nb"\n2,c\nx,d\n3\n4,"e\nf",g\n'])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    row = FS.bad_record_report(spark, path, schema).first()
    assert (row["n_rows"], row["n_bad_rows"]) == (5, 3)


def test_files_without_line_breaks_are_read_line_by_line(spark, tmp_path):
    path = _write(tmp_path / "p.csv", ['id,t\n1,"a,b"\n2,5" pipe\n'])
    df = FS.read_csv(spark, path)
    assert _rows(df) == [("1", "a,b"), ("2", '5" pipe')]
    assert "MapInArrow" not in df._jdf.queryExecution().toString()


@given(st.lists(st.sampled_from(["a", ",", '"', '""', '",', ',"', "b c"]), max_size=12).map("".join), st.booleans())
@settings(max_examples=300, deadline=None)
def test_end_of_line_state(line, inside):
    state = "in" if inside else "start"
    for ch in line:  # character by character
        if state == "start":
            state = "in" if ch == '"' else "start" if ch == "," else "plain"
        elif state == "plain":
            state = "start" if ch == "," else "plain"
        elif state == "in":
            state = "quote" if ch == '"' else "in"
        else:
            state = "in" if ch == '"' else "start" if ch == "," else "plain"
    assert csv_records.ends_inside(line, inside) == (state == "in")


# ------------------------------------------------------------------ categories
def test_many_categories(spark, tmp_path):
    n = 100_000
    train = spark.range(n).select(F.format_string("c%06d", "id").alias("manufacturer"),
                                  F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("criticality"))
    columns = ["manufacturer", "criticality"]
    table = X.category_table(train, columns, str(tmp_path / "cats")).cache()
    assert table.count() == n + 2 and table.agg(F.count_distinct("position"), F.min("position"), F.max("position")).first()[:] == (n + 2, 0, n + 1)
    assert [tuple(r) for r in table.orderBy("position").limit(3).collect()] == [
        ("criticality", "None", 0), ("criticality", "hot", 1), ("manufacturer", "c000000", 2)]
    rows = spark.createDataFrame([(1, "c000005", "hot"), (2, "new", None), (3, None, "new"), (3, None, "new")],
                                 "id int, manufacturer string, criticality string")
    got = sorted((r["id"], r["onehot"].size, r["onehot"].indices.tolist()) for r in X.category_vectors(rows, table, columns).collect())
    assert got == [(1, n + 2, [1, 7]), (2, n + 2, [0]), (3, n + 2, []), (3, n + 2, [])]


def test_category_table_of_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "manufacturer string")
    table = X.category_table(none, ["manufacturer"], str(tmp_path / "none"))
    rows = X.with_categories(spark.createDataFrame([("a",)], "manufacturer string"), table, ["manufacturer"])
    assert table.count() == 0 and rows.first()["active"] == []


# ------------------------------------------------------------------ mapping, registry
def test_mapping_problems():
    assert [(p.kind, p.field, p.column) for p in M.mapping_problems({"manufacturer": "Make"}, ["Asset ID"])] == [
        ("unmapped", "machine_id", None), ("absent", "manufacturer", "Make")]


def test_column_goes_to_one_field():
    m = M.suggest_mapping(["Asset_ID", "Total Cost", "Cost per work order", "category of asset type"])
    assert m["machine_id"] == "Asset_ID" and m["total_cost"] == "Total Cost" and m["equipment_category"] == "category of asset type"
    assert len([c for c in m.values() if c]) == 3


def test_extra_names_past_names_in_use():
    assert [n for _c, n in M.extra_names(["a", "a_2", "A", "a 2", "a!"], set())] == [
        "extra__a", "extra__a_2", "extra__a_3", "extra__a_2_2", "extra__a_4"]


def test_groups(spark):
    df = spark.createDataFrame([("m", 1)], "machine_id string, overdue_pms int")
    with pytest.warns(UserWarning, match="events"):
        assert X.feature_columns(df, ["events"]) == []
    with pytest.raises(ValueError, match="unheard"):
        X.feature_columns(df, ["unheard"])


def test_ratio_guards(spark):
    rows = [(2.0, 1.0, 0.0, -1.0, 5.0), (0.0, 0.0, 1.0, 1.0, None), (None, 3.0, None, None, 1.0)]
    df = spark.createDataFrame(rows, "overdue_pms double, total_completed_pms double, overdue_wos double, total_completed_wos double, downtime_minutes double")
    got = [tuple(r) for r in df.select(*X.ratio_features(df)).collect()]
    assert got == [(1.0, None, None, 1 / 3), (0.0, 0.5, None, 1.0), (None, None, None, 1.0)]
