"""Every registered query of the library equals its DuckDB SQL."""

from __future__ import annotations

import pytest
from oracle import connect, difference

from dossier import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    found = QUERIES[name](spark, sf)
    assert name in SQL
    assert difference(found, SQL[name], con) == ""
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_sizes_of_the_registry():
    assert len(QUERIES) > 120 and set(SQL) <= set(QUERIES)
