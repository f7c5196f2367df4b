import pytest

from tessera.plans import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    same(QUERIES[name](spark, small), small, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_no_python_in_plans(spark, small):
    for name, f in QUERIES.items():
        plan = f(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["page_orders"](spark, small)._jdf.queryExecution().executedPlan().toString()  # the filter of loads from a mark is tested in test_build
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "o_totalprice" not in plan.partition("ReadSchema")[2]
