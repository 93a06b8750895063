import pytest
from compare import same

from lexmill.plans import queries as library


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_matches_sql(spark, data, name):
    same(library.QUERIES[name](spark, data), library.ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_query_without_sql_has_rows(spark, data, name):
    assert library.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
