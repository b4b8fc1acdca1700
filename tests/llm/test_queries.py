import pytest

from folioflux.llm.queries import oracle_sql, queries

from ..oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, SF, queries()[name], oracle_sql()[name])


def test_all_ten_are_there():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 11))
