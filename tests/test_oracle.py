"""Every registered query with SQL gives the same rows in Spark and DuckDB on the smallest dataset."""

from __future__ import annotations

import pytest
from auditloom.plans import registry
from harness import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df, sql = registry.queries()[name](spark, SF), registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, sql, con) == ""
