"""Every query that SQL can express, against DuckDB; the others at least run."""

from __future__ import annotations

import pytest

from gantry.plans.catalog import ORACLE_SQL, QUERIES
from tests.compare import DATA, connection, differences

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
