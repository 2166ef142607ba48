"""Merging of parallel payments: what travels, and the last one by date."""

import datetime

from pyspark.sql import functions as F

from tallyscope.operators import graph

DAY = datetime.date(2024, 1, 5)
PAID = [(1, 1, 7, 5.0, DAY), (1, 1, 7, 9.0, None), (1, 1, 7, 6.0, DAY), (1, 2, None, 4.0, None), (None, 2, 7, 3.0, DAY), (2, 1, 7, None, DAY), (2, 1, 7, 8.0, None)]


def network(spark):
    paid = spark.createDataFrame(PAID, "worker_id long, work_id long, account long, amount double, paid_on date")
    works = spark.createDataFrame([(1, 3), (1, 3), (2, None)], "work_id long, panchayat int")
    return graph.worker_network(paid, works)


def test_last_payment_of_an_edge(spark):
    nodes, edges = network(spark)
    got = {(r["src"], r["dst"]): (r["edge_type"], r["amount"], r["ts"]) for r in edges.collect()}
    assert got == {
        ("panchayat_3", "work_1"): ("belongs_to", 0.0, None), ("work_1", "worker_1"): ("enrolled_in", 6.0, DAY), ("work_2", "worker_1"): ("enrolled_in", 4.0, None),
        ("work_1", "worker_2"): ("enrolled_in", None, DAY), ("account_7", "work_1"): ("paid_to", 6.0, DAY), ("account_7", "work_2"): ("paid_to", 3.0, DAY),
        ("account_7", "worker_1"): ("paid_to", 6.0, DAY), ("account_7", "worker_2"): ("paid_to", None, DAY),
    }
    assert nodes.count() == 6


def exchanged(df):
    """The plan of ``df``, which has exchanges."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan
    return plan


def test_payments_travel_by_plain_ids(spark):
    plan = exchanged(network(spark)[1])
    partial = [line for line in plan.splitlines() if "partial_" in line]
    assert partial and all("keys=[src" not in line and "max_by" not in line for line in partial)


def test_parallel_edges_travel_once(spark):
    rows = [("a", "b", "x", 2.0, None), ("a", "b", "y", 1.0, DAY), ("a", "b", "z", 1.0, DAY), ("a", "c", "x", None, None)]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_type string, amount double, ts date")
    last = graph.merge_parallel(edges)
    assert sorted(map(tuple, last.collect())) == [("a", "b", "z", 1.0, DAY), ("a", "c", "x", None, None)]
    assert sorted(map(tuple, graph.merge_parallel(edges, "sum").collect())) == [("a", "b", "z", 4.0, DAY), ("a", "c", "x", None, None)]
    assert "max_by" not in exchanged(last)
    assert last.columns == ["src", "dst", "edge_type", "amount", "ts"]
    assert last.agg(F.count("*")).first()[0] == 2
