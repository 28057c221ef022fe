"""Queries that SQL can express, against their SQL."""

import pytest

from bytemill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(name, spark):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
