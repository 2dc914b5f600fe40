"""Every named query against its DuckDB SQL on the smallest tables."""

import pytest
from oracle import duck, same

from rill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], con)


def test_every_query_without_sql_runs(spark):
    for name in registry.QUERIES.keys() - registry.ORACLES.keys():
        assert registry.QUERIES[name](spark, SF).count() > 0
