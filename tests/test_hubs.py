"""Hub accounts: what travels, and accounts with many panchayats within two steps."""

from tallyscope.operators import graph


def test_edges_meet_accounts_and_panchayats_where_they_are(spark):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # less than the edges take
    try:
        check_hubs(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def check_hubs(spark):
    rows = [(f"account_{w % 10}", f"work_{w}", 2.0) for w in range(4000)] + [(f"panchayat_{w % (w % 10 + 1)}", f"work_{w}", 0.0) for w in range(4000)]
    rows += [("account_1", "panchayat_7", 1.0), ("account_1", "panchayat_7", 1.0), ("account_0", "worker_1", None)]
    edges = graph.durable(spark.createDataFrame(rows, "src string, dst string, amount double"))
    got = graph.hub_accounts(graph.nodes_of(edges), edges, at_least=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # only what accounts reach and where works lie travels, not every edge to its ends
    assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "LeftSemi" in x]
    reach = {}
    for a in range(10):
        ends = {f"panchayat_{w % (w % 10 + 1)}" for w in range(4000) if w % 10 == a} | ({"panchayat_7"} if a == 1 else set())
        reach[f"account_{a}"] = (len(ends), 800.0 + (2.0 if a == 1 else 0.0), 400 + (2 if a == 1 else 1 if a == 0 else 0))
    assert {r["account_node"]: (r["panchayats"], r["total_amount"], r["edges"]) for r in got.collect()} == {k: v for k, v in reach.items() if v[0] >= 3}
