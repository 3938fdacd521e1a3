"""Every registered query of the library against its SQL, on whole tables."""

import pytest
from oracle import compare

from shoebox import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    assert compare(spark, registry.QUERIES[name], registry.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert e.oracle_sql().keys() <= e.queries().keys()
