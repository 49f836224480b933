"""Every registered query against its DuckDB oracle at sf0.01 (rows-only ones at sf0.001)."""

import pytest

from freightcube.plans.catalog import ORACLE_SQL, QUERIES

from conftest import SF_ORACLE, SF_SMALL
from oracle import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, con, name):
    problems, _ = compare(QUERIES[name](spark, SF_ORACLE), con, ORACLE_SQL[name])
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0
