import pytest

from folioflux.plans.queries import ORACLES, QUERIES

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    same(spark, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_works_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
