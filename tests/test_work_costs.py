"""Costs of works: what is paid by work, and the tasks it is dealt over."""

import pytest

from tallyscope import session
from tallyscope.bindings import audits


class Given:
    def __init__(self, **tables):
        self.__dict__.update(tables)


LINES = [(1, 5, "O", 10.5, 20.0), (1, 5, "F", 4.25, 29.0), (2, 5, "O", 1.0, 30.0), (2, 6, "F", None, 1.0), (3, None, "F", 2.0, 5.0), (4, 7, "O", 3.0, 5.0), (9, 7, "O", 3.0, 5.0)]


def given(spark):
    return Given(
        lineitem=spark.createDataFrame(LINES, "l_orderkey long, l_suppkey long, l_linestatus string, l_extendedprice double, l_quantity double"),
        orders=spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 8)], "o_orderkey long, o_custkey long"),
        customer=spark.createDataFrame([(1, 3), (2, 4)], "c_custkey long, c_nationkey int"),
    )


def test_costs_of_works(spark):
    got = sorted(map(tuple, audits.work_costs(given(spark)).collect()))
    assert got == [(1, 1, 3, 10.5, 4.25, True, True), (2, 1, 3, 1.0, 0.0, False, False), (3, 2, 4, 0.0, 2.0, True, True)]


def test_payments_travel_by_work_only(spark):
    plan = audits.work_costs(given(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan
    top, below = plan.index("Join Inner"), plan.index("Aggregate [work_id")
    assert top < below  # works are summed before they are joined


@pytest.mark.parametrize("rows, tasks", [(1000, None), (30, 34)])
def test_tasks_follow_the_rows(spark, rows, tasks):
    df = spark.range(1000).selectExpr("id % 97 AS k", "id")
    dealt = session.spread(df, "k", rows=rows)
    assert (dealt is df) if tasks is None else (dealt.rdd.getNumPartitions() == tasks)
    assert dealt.selectExpr("sum(id)").first()[0] == 499_500
