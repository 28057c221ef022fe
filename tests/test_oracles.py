"""Every query of the library against its SQL, over the smallest tables."""

import pytest

import bytemill.operators  # noqa: F401
from bytemill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(catalog.queries()[name], catalog.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_query_without_sql_runs(name, spark):
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").columns
