"""Every query that SQL can express equals its SQL; the others run and have stable columns."""

import pytest

from loomstone import registry

from .oracle import connection, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_its_sql(spark, con, name):
    same(spark, con, registry.QUERIES[name], registry.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys()))
def test_runs(spark, name):
    out = registry.QUERIES[name](spark, SF)
    assert out.columns == registry.QUERIES[name](spark, SF).columns and out.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
