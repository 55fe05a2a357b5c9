"""Every registered core query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from marginalia.queries import registry
from tests import oracle

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_parity(spark, con, name):
    oracle.same(spark, con, D, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, D)
    assert df.columns and df.count() >= 0
