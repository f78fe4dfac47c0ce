"""Queries on several serving tables build each table once."""

import datetime

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name, rows", [("alert_status_update", None), ("cascade_delete", 5)])
def test_tables_are_built_once(spark, tmp_path, name, rows):
    d = str(tmp_path)
    spark.createDataFrame([(i, i % 25, float(i * 37 % 9000), f"SEG{i % 5}") for i in range(60)],
                          "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    day = datetime.datetime(1998, 1, 1)
    spark.createDataFrame([(i, i % 60, "OFP"[i // 60 % 3], 1000.0 + i * 131 % 90000, day + datetime.timedelta(days=i % 300), ("1-URGENT", "5-LOW")[i % 2])
                           for i in range(600)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    out = entry.queries()[name](spark, d)
    assert "FileScan parquet" not in out._jdf.queryExecution().toString()
    found = out.collect()
    assert found and (rows is None or len(found) == rows)
