import __spark_entry__
import pytest
from oracle import same

from skyledger.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
