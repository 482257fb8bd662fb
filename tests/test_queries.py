import pytest

from tessella.plans import registry
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "key", "rank", "distance"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
