"""Every registered query equals its DuckDB oracle at sf0.001."""

import pytest

from tests.conftest import SF_SMALL
from vigil.plans import registry
from vigil.plans.checking import compare, duck_connect

registry.load_all()
NAMES = sorted(registry.ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(registry.QUERIES[name](spark, SF_SMALL), con, registry.ORACLE[name])
    assert res["match"], res


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_oracle_runs(spark, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
