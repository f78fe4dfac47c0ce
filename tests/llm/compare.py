"""Compare a query with its DuckDB text on a folder of tables."""

import glob
import os

import duckdb
import pandas as pd


def oracle_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con.execute(sql).df()


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
