"""Every query of the core against its SQL, on the smallest tables."""

import pytest
from compare import compare
from conftest import DATA

from palimpsest.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got, want, same = compare(spark, DATA, registry.queries()[name], SQL.get(name))
    assert same, (len(got), len(want), sorted(set(got) ^ set(want), key=repr)[:4])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "id", "rank", "used"]
    assert set(e.oracle_sql()) <= set(e.queries())
