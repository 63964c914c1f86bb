"""Queries of the training-data operators with SQL give the same rows in Spark and DuckDB on the smallest dataset."""

from __future__ import annotations

import pytest
from auditloom.llm import queries
from harness import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    assert differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], con) == ""
