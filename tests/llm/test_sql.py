"""Queries with DuckDB texts, at the smallest size."""

import pytest
from compare import assert_same, oracle_rows

from upkeep.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    want = oracle_rows(queries.ORACLE[name], SF)
    assert_same(queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)], want)
