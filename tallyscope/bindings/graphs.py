"""Graph operators: payment graphs from line items, a sparse flow graph from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import durable
from . import roles
from .base import Tables, query, rnd
from .roles import PAYMENTS


def network(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = roles.payments(t)
    works = p.select("work_id", F.col("district").alias("panchayat")).distinct()
    return G.worker_network(p, works)


def written_network(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The network written once, for queries that read its edges several times."""
    edges = durable(network(t)[1])
    return G.nodes_of(edges), edges


_NET = (PAYMENTS + ", ne AS (SELECT 'work_' || work_id AS a, 'panchayat_' || district AS b, 0.0::DOUBLE AS amount, NULL::DATE AS ts, 'belongs_to' AS et FROM payments GROUP BY 1, 2 "
        "UNION ALL SELECT 'worker_' || worker_id, 'work_' || work_id, amount, paid_on, 'enrolled_in' FROM payments UNION ALL SELECT 'work_' || work_id, 'account_' || account, amount, paid_on, 'paid_to' FROM payments "
        "UNION ALL SELECT 'worker_' || worker_id, 'account_' || account, amount, paid_on, 'paid_to' FROM payments), "
        "net AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, arg_max(amount, (ts IS NOT NULL, ts, amount, et)) AS amount FROM ne GROUP BY 1, 2), "
        "bi AS (SELECT src, dst, amount FROM net UNION ALL SELECT dst, src, amount FROM net)")


@query("g1_worker_network", f"WITH {_NET} SELECT src, dst, amount FROM net")
def g1(t: Tables) -> DataFrame:
    return network(t)[1].select("src", "dst", "amount")


def flow(t: Tables) -> tuple[DataFrame, DataFrame]:
    ftos = t.orders.select(F.col("o_orderkey").alias("fto_id"), F.col("o_custkey").alias("panchayat"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("issued_on"))
    pay = t.lineitem.select(F.col("l_orderkey").alias("fto_id"), F.col("l_suppkey").alias("account"), F.col("l_extendedprice").alias("amount"), F.to_date("l_shipdate").alias("paid_on"))
    return G.fund_flow(ftos, pay)


@query("g2_fund_flow", "WITH e AS (SELECT 'panchayat_' || o_custkey AS src, 'fto_' || o_orderkey AS dst, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS ts FROM orders "
       "UNION ALL SELECT 'fto_' || l_orderkey, 'account_' || l_suppkey, l_extendedprice, CAST(l_shipdate AS DATE) FROM lineitem) SELECT src, dst, arg_max(amount, (ts, amount)) AS amount FROM e GROUP BY 1, 2")
def g2(t: Tables) -> DataFrame:
    return flow(t)[1].select("src", "dst", "amount")


def district_graph(t: Tables, mode: str = "last") -> tuple[DataFrame, DataFrame]:
    p = roles.payments(t)
    tag = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    tr = p.select(
        tag("P", "panchayat").alias("panchayat"), tag("W", "work_id").alias("work_id"), F.concat_ws("-", tag("F", "work_id"), F.col("line").cast("string")).alias("fto_id"),
        tag("A", "account").alias("account"), tag("K", "worker_id").alias("worker_id"), "officer", "amount", "paid_on",
    )
    mat = p.filter("material_type = 'R'").select(tag("V", "account").alias("vendor_id"), tag("W", "work_id").alias("work_id"), "amount", "paid_on")
    return G.payment_graph(tr, mat, mode)


_G3 = (PAYMENTS + ", pg AS (SELECT 'P' || panchayat AS src, 'W' || work_id AS dst, 'sanctions' AS et, amount, paid_on AS ts FROM payments "
       "UNION ALL SELECT 'W' || work_id, 'F' || work_id || '-' || line, 'generates', amount, paid_on FROM payments UNION ALL SELECT 'F' || work_id || '-' || line, 'A' || account, 'pays', amount, paid_on FROM payments "
       "UNION ALL SELECT 'A' || account, 'K' || worker_id, 'belongs_to', 0, paid_on FROM payments UNION ALL SELECT officer, 'F' || work_id || '-' || line, 'approves', 0, paid_on FROM payments "
       "UNION ALL SELECT 'W' || work_id, 'V' || account, 'procures_from', amount, paid_on FROM payments WHERE material_type = 'R')")


@query("g3_payment_graph", f"WITH {_G3} SELECT src, dst, arg_max(et, (ts, amount, et)) AS edge_type, arg_max(amount, (ts, amount, et)) AS amount FROM pg GROUP BY 1, 2")
def g3(t: Tables) -> DataFrame:
    return district_graph(t)[1].select("src", "dst", "edge_type", "amount")


@query("g3_payment_graph_sums", f"WITH {_G3} SELECT src, dst, round(sum(amount), 2) AS amount FROM pg GROUP BY 1, 2")
def g3_sums(t: Tables) -> DataFrame:
    return district_graph(t, "sum")[1].select("src", "dst", rnd("amount", 2).alias("amount"))


@query("a15_graph_statistics", f"WITH {_NET}, n AS (SELECT DISTINCT src AS id FROM bi) SELECT 'node_type' AS kind, string_split(id, '_')[1] AS name, count(*) AS count FROM n GROUP BY 2 "
       "UNION ALL SELECT 'total', 'nodes', count(*) FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM net")
def a15(t: Tables) -> DataFrame:
    return G.statistics(*written_network(t))


_ACCOUNT = "o_custkey*4 + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
_FLOW = (f"oa AS (SELECT o_orderkey AS k, {_ACCOUNT} AS a, o_totalprice AS amount FROM orders), "
         "fe AS (SELECT p.a AS src, n.a AS dst, max(p.amount) AS amount FROM oa p JOIN oa n ON n.k = p.k + 1 WHERE p.a <> n.a GROUP BY 1, 2), "
         "fu AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM fe UNION ALL SELECT dst, src FROM fe))")


def account_flows(t: Tables) -> DataFrame:
    """Money from the account of each order to that of the next one; a customer has an account for each order status."""
    o = t.orders.select("o_orderkey", F.expr(_ACCOUNT).alias("a"), "o_totalprice")
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("a").alias("dst"))
    e = o.withColumnRenamed("a", "src").join(nxt, "o_orderkey").filter("src != dst")
    return e.groupBy("src", "dst").agg(F.max("o_totalprice").alias("amount"))


@query("g6_circular_flows", f"WITH RECURSIVE {_FLOW}, p(f, l, path, s) AS (SELECT src, dst, [src, dst], amount FROM fe WHERE dst > src UNION ALL SELECT f, e.dst, list_append(path, e.dst), s + e.amount FROM p JOIN fe e ON e.src = l "
       "WHERE e.dst > f AND NOT list_contains(path, e.dst) AND len(path) < 8), c AS (SELECT path, len(path) AS n, s + e.amount AS amt FROM p JOIN fe e ON e.src = l AND e.dst = f WHERE len(path) >= 3), "
       "d AS (SELECT list_sort(path) AS m, n, arg_min(amt, path) AS amt, min(path) AS path FROM c GROUP BY 1, 2) SELECT array_to_string(path, '>') AS path, CAST(n AS INTEGER) AS length, round(amt, 2) AS total_amount FROM d")
def g6(t: Tables) -> DataFrame:
    c = G.distinct_cycles(G.cycles(account_flows(t)))
    return c.select(F.array_join(F.transform("path", lambda v: v.cast("string")), ">").alias("path"), "length", rnd("total_amount", 2).alias("total_amount"))


_OFFICIAL = (_FLOW + ", fp(f, l, path, s, w) AS (SELECT src, dst, [src, dst], amount, amount FROM fe WHERE dst > src UNION ALL SELECT f, e.dst, list_append(path, e.dst), s + e.amount, least(w, e.amount) FROM fp JOIN fe e ON e.src = l "
             "WHERE e.dst > f AND NOT list_contains(path, e.dst) AND len(path) < 8), fc AS (SELECT path, len(path) AS n, s + e.amount AS amt, least(w, e.amount) AS mn FROM fp JOIN fe e ON e.src = l AND e.dst = f WHERE len(path) >= 3), "
             "oc AS (SELECT *, len(list_filter(path, lambda x: x // 4 % 5 = 0)) AS oc, len(list_filter(path, lambda x: x // 4 % 5 = 1)) AS pc FROM fc), "
             "official AS (SELECT path, amt, mn, CASE WHEN oc > 0 THEN 0.7::DOUBLE ELSE 0.5 END + CASE WHEN n <= 4 THEN 0.1::DOUBLE ELSE 0 END AS confidence FROM oc WHERE oc > 0 OR pc > 0)")


def official_flows(t: Tables) -> DataFrame:
    customer = F.floor(F.col("id") / 4)
    kinds = F.when(customer % 5 == 0, "official").when(customer % 5 == 1, "panchayat").otherwise("bank_account")
    nodes = t.orders.select(F.expr(_ACCOUNT).alias("id")).distinct().withColumn("node_type", kinds)
    return G.official_cycles(G.cycles(account_flows(t)), nodes)


@query("g7_official_cycles", f"WITH RECURSIVE {_OFFICIAL} SELECT array_to_string(path, '>') AS path, round(amt, 2) AS total_amount, round(mn, 2) AS min_amount, confidence FROM official")
def g7(t: Tables) -> DataFrame:
    c = official_flows(t)
    return c.select(F.array_join(F.transform("path", lambda v: v.cast("string")), ">").alias("path"), rnd("total_amount", 2).alias("total_amount"), rnd("min_amount", 2).alias("min_amount"), "confidence")


@query("g8_hub_accounts", f"WITH {_NET}, r AS (SELECT a.src, b.dst FROM bi a JOIN bi b ON a.dst = b.src WHERE a.src LIKE 'account%' AND b.dst LIKE 'panchayat%' UNION SELECT src, dst FROM bi WHERE src LIKE 'account%' AND dst LIKE 'panchayat%'), "
       "c AS (SELECT src, count(*) AS panchayats FROM r GROUP BY 1), m AS (SELECT src, round(sum(amount), 2) AS total_amount, count(*) AS edges FROM bi WHERE src LIKE 'account%' GROUP BY 1) SELECT src AS account_node, panchayats, total_amount, edges FROM c JOIN m USING (src) WHERE panchayats >= 5")
def g8(t: Tables) -> DataFrame:
    return G.hub_accounts(*written_network(t)).withColumn("total_amount", rnd("total_amount", 2))


@query("g9_degree_centrality", f"WITH {_FLOW}, d AS (SELECT src AS id, count(*) AS degree FROM fu GROUP BY 1) SELECT id, degree, round(degree*1.0::DOUBLE/((SELECT count(*) FROM d) - 1), 8) AS centrality FROM d")
def g9(t: Tables) -> DataFrame:
    return G.degrees(account_flows(t)).withColumn("centrality", rnd("centrality", 8))


_CUST = ("ce AS (SELECT p.o_custkey AS src, n.o_custkey AS dst, sum(CAST(p.o_totalprice AS DECIMAL(18,2))) AS amount FROM orders p JOIN orders n ON n.o_orderkey = p.o_orderkey + 1 WHERE p.o_custkey <> n.o_custkey GROUP BY 1, 2), "
         "cb AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce)")


def customer_flows(t: Tables) -> DataFrame:
    """Money from the customer of each order to that of the next one."""
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("src"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("src").alias("dst"))
    return o.join(nxt, "o_orderkey").filter("src != dst").groupBy("src", "dst").agg(F.sum("amount").alias("amount"))


# breadth-first levels and dependencies of all customers; no level is past the tenth here
_DEEP = 10
_LEVELS = ", ".join(
    f"l{i} AS MATERIALIZED (SELECT p.s, e.dst AS v, sum(p.g) AS g FROM l{i - 1} p JOIN cb e ON e.src = p.v WHERE NOT EXISTS (SELECT 1 FROM l{i - 1} q WHERE q.s = p.s AND q.v = e.dst) "
    f"AND NOT EXISTS (SELECT 1 FROM l{max(i - 2, 0)} q WHERE q.s = p.s AND q.v = e.dst) GROUP BY 1, 2)" for i in range(1, _DEEP + 1))
_BACK = ", ".join(
    f"b{i} AS MATERIALIZED (SELECT l.s, l.v, l.g, l.g * coalesce(sum((1 + u.d) / u.g), 0) AS d FROM l{i} l LEFT JOIN (SELECT b.s, b.d, b.g, e.dst AS v FROM b{i + 1} b JOIN cb e ON e.src = b.v) u ON u.s = l.s AND u.v = l.v GROUP BY 1, 2, 3)"
    for i in range(_DEEP - 1, 0, -1))


@query("g5_bridge_nodes", f"WITH {_CUST}, l0 AS MATERIALIZED (SELECT DISTINCT src AS s, src AS v, 1.0::DOUBLE AS g FROM cb), {_LEVELS}, b{_DEEP} AS (SELECT s, v, g, 0.0::DOUBLE AS d FROM l{_DEEP}), {_BACK}, "
       "bc AS (SELECT v AS id, sum(d) AS b FROM (" + " UNION ALL ".join(f"SELECT v, d FROM b{i}" for i in range(1, _DEEP)) + ") GROUP BY 1), "
       "nn AS (SELECT count(DISTINCT src)::DOUBLE AS n FROM cb), dg AS (SELECT src AS id, count(*) AS degree FROM cb GROUP BY 1), "
       "f AS (SELECT id, degree, coalesce(b, 0)/((n-1)*(n-2)) AS betweenness FROM dg LEFT JOIN bc USING (id), nn) SELECT id, degree, round(betweenness, 8) AS betweenness, 0.0::DOUBLE AS error FROM f ORDER BY round(betweenness, 10) DESC, id LIMIT 20")
def g5(t: Tables) -> DataFrame:
    # up to 2048 pivots: exact on graphs of so many vertices, beyond with an error
    return G.bridges(customer_flows(t), 20, pivots=2048, batch=512).select("id", "degree", rnd("betweenness", 8).alias("betweenness"), rnd("error", 8).alias("error"))


# power iteration on A + I, scaled so that values stay in range
_POWER = ", ".join(f"x{i} AS MATERIALIZED (SELECT id, sum(y)/16 AS y FROM (SELECT e.dst AS id, x.y FROM x{i - 1} x JOIN fu e ON e.src = x.id UNION ALL SELECT id, y FROM x{i - 1}) GROUP BY 1)" for i in range(1, 121))


@query("g10_eigenvector", f"WITH {_FLOW}, x0 AS (SELECT DISTINCT src AS id, 1.0::DOUBLE AS y FROM fu), {_POWER} SELECT id, round(y / (SELECT sqrt(sum(y*y)) FROM x120), 6) AS eigenvector FROM x120")
def g10(t: Tables) -> DataFrame:
    return G.eigenvector(account_flows(t), tolerance=1e-13).withColumn("eigenvector", rnd("eigenvector", 6))


_NEAR = (f"{_FLOW}, s0 AS (SELECT src AS id FROM (SELECT DISTINCT src FROM fu) JOIN customer ON src // 4 = c_custkey WHERE c_acctbal < -900), s1 AS (SELECT DISTINCT dst AS id FROM fu JOIN s0 ON src = id WHERE dst NOT IN (SELECT id FROM s0)), "
         "s2 AS (SELECT DISTINCT dst AS id FROM fu JOIN s1 ON src = id WHERE dst NOT IN (SELECT id FROM s0) AND dst NOT IN (SELECT id FROM s1)), "
         "nb AS (SELECT id, 0 AS distance FROM s0 UNION ALL SELECT id, 1 FROM s1 UNION ALL SELECT id, 2 FROM s2)")


def around_suspects(t: Tables) -> tuple[DataFrame, DataFrame]:
    overdrawn = t.customer.filter("c_acctbal < -900").select(F.col("c_custkey").alias("customer"))
    flows = durable(account_flows(t))
    suspects = G.nodes_of(flows).select("id").withColumn("customer", F.floor(F.col("id") / 4)).join(overdrawn, "customer")
    return G.neighbourhood(flows, suspects, 2)


@query("g11_neighbourhood", f"WITH {_NEAR} SELECT id, distance FROM nb")
def g11(t: Tables) -> DataFrame:
    return around_suspects(t)[0]


@query("g11_induced_edges", f"WITH {_NEAR} SELECT src, dst, amount FROM fe WHERE src IN (SELECT id FROM nb) AND dst IN (SELECT id FROM nb)")
def g11_edges(t: Tables) -> DataFrame:
    return around_suspects(t)[1].select("src", "dst", "amount")


@query("g12_export_nodes", f"WITH {_NET}, d AS (SELECT src AS id, count(*) AS degree FROM bi GROUP BY 1) SELECT id, string_split(id, '_')[1] AS node_type, degree, id LIKE 'account%' AND degree > 1000 AS is_anomalous, greatest(5, least(30, degree*2)) AS size FROM d")
def g12(t: Tables) -> DataFrame:
    nodes, edges = written_network(t)
    hot = G.degrees(edges).filter("degree > 1000 and id like 'account%'")
    return G.export_nodes(nodes, edges, hot)


@query("g12_export_edges", f"WITH {_NET} SELECT src, dst, amount FROM net")
def g12_edges(t: Tables) -> DataFrame:
    return written_network(t)[1].select("src", "dst", "amount")


@query("g12_export_statistics", f"WITH {_NET}, n AS (SELECT count(DISTINCT src) AS nodes FROM bi), m AS (SELECT count(*) AS edges FROM net) SELECT nodes, edges, round(2.0::DOUBLE*edges/(nodes::DOUBLE*(nodes - 1)), 10) AS density FROM n, m")
def g12_stats(t: Tables) -> DataFrame:
    return G.export_statistics(*written_network(t)).withColumn("density", rnd("density", 10))


@query("g13_rapid_movement", "SELECT l_orderkey, count(*) AS payments, count(DISTINCT l_suppkey) AS accounts, round((max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate)))/3.6e9, 4) AS span_hours, "
       "CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS total_amount FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_suppkey) >= 2 AND (max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate)))/3.6e9 <= 720")
def g13(t: Tables) -> DataFrame:
    li = t.lineitem.withColumn("amount", F.col("l_extendedprice").cast("decimal(14,2)"))
    r = G.rapid_movement(li, "l_orderkey", "l_suppkey", "l_shipdate", "amount", 720)
    return r.select("l_orderkey", "payments", "accounts", rnd("span_hours").alias("span_hours"), F.col("total_amount").cast("double").alias("total_amount"))


@query("g4_communities")
def g4(t: Tables) -> DataFrame:
    e = durable(customer_flows(t))
    return G.community_profile(G.communities(e), e).select("community", "size", "internal_edges", "total_amount")
