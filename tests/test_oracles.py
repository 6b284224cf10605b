"""Every query with SQL gives the same rows as DuckDB does on the same tables."""

from __future__ import annotations

import pytest

from loomtrace.plans import all_queries, all_sql
from tests.oracle import difference, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_rows(spark, sf, con, name):
    assert difference(spark, con, all_queries()[name], all_sql()[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs(spark, sf, name):
    assert all_queries()[name](spark, sf).count() > 0
