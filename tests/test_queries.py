import pytest

from chronarch.plans.queries import QUERIES, SQL

from against import assert_same
from conftest import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert_same(spark, duck, QUERIES[name], SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["geo_value", "grp", "time_value", "version", "value_7dsum"]
    assert set(e.oracle_sql()) <= set(e.queries())
