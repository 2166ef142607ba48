"""Graph operators on edge tables.

Iterative operators cut lineage through the shared checkpoint folder each round and
take only a stop flag or a single number to the driver.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, spread


#: Links, counted from both ends, of a graph that one task can hold.
_WHOLE_LINKS = 4_000_000


def connected_components(edges: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Smallest vertex of every vertex's component: ``scope, v, component``.

    Alternating big-star and small-star steps, which halve distances to the
    smallest vertex and need few rounds; a hub is never expanded pairwise.
    """
    scope = list(scope)
    cols = [*scope, "a", "b"]

    def both(e: DataFrame) -> DataFrame:
        return e.select(*cols).unionByName(e.select(*scope, F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, small: bool) -> DataFrame:
        # hang neighbours (only the smaller ones, for the small step) under the least of them
        near = e.filter("b < a") if small else both(e)
        low = near.groupBy(*scope, "a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        hung = near.join(low, [*scope, "a"]).filter(F.col("b") != F.col("_m"))
        if not small:
            hung = hung.filter("b > a")
        link = hung.select(*scope, F.col("b").alias("a"), F.col("_m").alias("b"))
        if small:
            link = link.unionByName(low.select(*scope, "a", F.col("_m").alias("b")))
        return link.filter("a != b").distinct()

    pairs = edges.filter("a != b").select(*scope, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = durable(pairs)
    seen = None
    while True:
        nxt = durable(star(star(state, False), True))
        mark = nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*cols))).first()
        if seen == tuple(mark):
            break
        seen, state = tuple(mark), nxt
    roots = nxt.select(*scope, F.col("b").alias("v")).distinct().join(
        nxt.select(*scope, F.col("a").alias("v")).distinct(), [*scope, "v"], "left_anti"
    )
    out = nxt.select(*scope, F.col("a").alias("v"), F.col("b").alias("component"))
    loops = edges.filter("a = b").select(*scope, F.col("a").alias("v")).distinct().join(
        out.select(*scope, "v").unionByName(roots), [*scope, "v"], "left_anti"
    )
    alone = roots.unionByName(loops).withColumn("component", F.col("v"))
    return out.unionByName(alone)


# -- building -------------------------------------------------------------------------

def _node(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.col(col).cast("string"))


def worker_network(payments: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, undirected edges) of workers, works, accounts and panchayats.

    Parallel payments become one edge that keeps the last amount by date.
    """
    at = works.filter(F.col("panchayat").isNotNull()).select(
        F.col("work_id").alias("a"), F.col("panchayat").alias("b"), F.lit(0.0).alias("amount"), F.lit(None).cast(payments.schema["paid_on"].dataType).alias("ts"),
    ).distinct()

    def pay(a: str, b: str, deal: bool = False) -> DataFrame:
        paid = payments.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col("paid_on").alias("ts"), F.col("amount").cast("double").alias("amount"))
        paid = spread(paid, "a", "b") if deal else paid  # pairs of a work are together where its payments are
        paid = paid.groupBy("a", "b").agg(F.max(F.struct("ts", "amount")).alias("_last"))
        return paid.select("a", "b", "_last.amount", "_last.ts")

    def named(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
        x, y = _node(a, "a"), _node(b, "b")
        return df.select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"), F.lit(kind).alias("edge_type"), "amount", "ts")

    # ends of different kinds never meet, so every kind is merged by its plain ids and named after
    merged = (
        named(at, "work", "panchayat", "belongs_to").unionByName(named(pay("worker_id", "work_id"), "worker", "work", "enrolled_in"))
        .unionByName(named(pay("work_id", "account"), "work", "account", "paid_to")).unionByName(named(pay("worker_id", "account", deal=True), "worker", "account", "paid_to"))
    )
    return nodes_of(merged), merged


def fund_flow(ftos: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, directed edges) panchayat -> order -> account."""
    a = ftos.filter(F.col("panchayat").isNotNull()).select(
        _node("panchayat", "panchayat").alias("src"), _node("fto", "fto_id").alias("dst"), F.lit("authorised_by").alias("edge_type"),
        F.col("amount").cast("double").alias("amount"), F.col("issued_on").alias("ts"),
    )
    b = payments.select(
        _node("fto", "fto_id").alias("src"), _node("account", "account").alias("dst"), F.lit("paid_to").alias("edge_type"),
        F.col("amount").cast("double").alias("amount"), F.col("paid_on").alias("ts"),
    )
    merged = merge_parallel(a.unionByName(b))
    return nodes_of(merged), merged


def payment_graph(transfers: DataFrame, materials: DataFrame, mode: str = "last") -> tuple[DataFrame, DataFrame]:
    """(nodes, directed edges) of a payment district, with unprefixed ids.

    ``transfers``: panchayat, work_id, fto_id, account, worker_id, officer, amount,
    paid_on. ``materials``: vendor_id, work_id, amount, paid_on.
    """
    def part(df: DataFrame, s: str, st: str, d: str, dt: str, kind: str, money: bool) -> DataFrame:
        amount = F.col("amount").cast("double") if money else F.lit(0.0)
        return df.filter(F.col(s).isNotNull() & F.col(d).isNotNull()).select(
            F.col(s).cast("string").alias("src"), F.col(d).cast("string").alias("dst"), F.lit(kind).alias("edge_type"), amount.alias("amount"),
            F.col("paid_on").alias("ts"), F.lit(st).alias("src_type"), F.lit(dt).alias("dst_type"),
        )

    parts = [
        part(transfers, "panchayat", "panchayat", "work_id", "work", "sanctions", True),
        part(transfers, "work_id", "work", "fto_id", "fto", "generates", True),
        part(transfers, "fto_id", "fto", "account", "bank_account", "pays", True),
        part(transfers, "account", "bank_account", "worker_id", "worker", "belongs_to", False),
        part(transfers.filter(F.col("officer") != ""), "officer", "official", "fto_id", "fto", "approves", False),
        part(materials, "work_id", "work", "vendor_id", "vendor", "procures_from", True),
    ]
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    ends = union.select(F.col("src").alias("id"), F.col("src_type").alias("node_type")).unionByName(
        union.select(F.col("dst").alias("id"), F.col("dst_type").alias("node_type"))
    )
    nodes = ends.groupBy("id").agg(F.max("node_type").alias("node_type"))
    return nodes, merge_parallel(union.select("src", "dst", "edge_type", "amount", "ts"), mode)


def merge_parallel(edges: DataFrame, mode: str = "last") -> DataFrame:
    """One edge per end points: the last one by time, or the sum of the amounts."""
    # one struct travels: its greatest is the last edge, as nulls come first
    last = F.max(F.struct("ts", F.col("amount").alias("_amount"), "edge_type")).alias("_last")
    if mode == "last":
        return edges.groupBy("src", "dst").agg(last).select("src", "dst", "_last.edge_type", F.col("_last._amount").alias("amount"), "_last.ts")
    return edges.groupBy("src", "dst").agg(last, F.sum("amount").alias("amount")).select("src", "dst", "_last.edge_type", "amount", "_last.ts")


def nodes_of(edges: DataFrame) -> DataFrame:
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ids.withColumn("node_type", F.split("id", "_")[0])


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without loops or repeats."""
    e = edges.filter("src != dst").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


# -- local measures --------------------------------------------------------------------

def degrees(edges: DataFrame) -> DataFrame:
    """Degree and degree centrality d / (n - 1) of every vertex."""
    both = undirected(edges)
    d = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    # a total of one row goes to every task
    return d.crossJoin(F.broadcast(n)).select(
        "id", "degree", F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(0.0).alias("centrality")
    )


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows ``kind, name, count``: totals and node types."""
    types = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("node_type").alias("kind"), F.col("node_type").alias("name"), "count"
    )
    total_n = nodes.agg(F.count(F.lit(1)).alias("count")).select(F.lit("total").alias("kind"), F.lit("nodes").alias("name"), "count")
    total_e = edges.agg(F.count(F.lit(1)).alias("count")).select(F.lit("total").alias("kind"), F.lit("edges").alias("name"), "count")
    return types.unionByName(total_n).unionByName(total_e)


def export_nodes(nodes: DataFrame, edges: DataFrame, anomalous: DataFrame | None = None) -> DataFrame:
    """Node table for drawing: type, degree-based size 5..30, anomaly flag."""
    out = nodes.join(degrees(edges).select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if anomalous is None:
        out = out.withColumn("is_anomalous", F.lit(False))
    else:
        out = out.join(anomalous.select("id").distinct().withColumn("_a", F.lit(True)), "id", "left").withColumn(
            "is_anomalous", F.coalesce("_a", F.lit(False))).drop("_a")
    return out.withColumn("size", F.greatest(F.lit(5), F.least(F.lit(30), F.col("degree") * 2)))


def export_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and the share of possible undirected edges that exist (``density``)."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    # two totals of one row each
    possible = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(F.broadcast(m)).withColumn("density", F.when(possible > 0, 2.0 * F.col("edges") / possible).otherwise(0.0))


def hub_accounts(nodes: DataFrame, edges: DataFrame, at_least: int = 5, account: str = "account", panchayat: str = "panchayat") -> DataFrame:
    """Accounts with many panchayats within two steps, and the money on their edges."""
    both = edges.select("src", "dst", "amount").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "amount"))
    # written, so that their size is known before edges are shuffled
    ends = durable(nodes.filter(F.col("node_type").isin(account, panchayat)).select("id", "node_type"))
    acc = ends.filter(F.col("node_type") == account).select(F.col("id").alias("src"))
    pan = ends.filter(F.col("node_type") == panchayat).select(F.col("id").alias("dst"))
    first = both.join(acc, "src", "left_semi")
    to_pan = both.join(pan, "dst", "left_semi").select("src", "dst").distinct()
    one = first.join(pan, "dst", "left_semi").select("src", "dst")
    two = spread(first.select("src", F.col("dst").alias("_m")), "_m").join(to_pan.withColumnRenamed("src", "_m"), "_m").select("src", "dst")
    reach = one.unionByName(two).distinct().groupBy("src").agg(F.count(F.lit(1)).alias("panchayats"))
    money = first.groupBy("src").agg(F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("edges"))
    return reach.filter(F.col("panchayats") >= at_least).join(money, "src").withColumnRenamed("src", "account_node")


def rapid_movement(df: DataFrame, fto: str, account: str, ts: str, amount: str, hours: float = 24) -> DataFrame:
    """Orders credited to two or more accounts within a day."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    dated = df.filter(F.col(fto).isNotNull() & F.col(ts).isNotNull())
    out = dated.groupBy(fto).agg(
        F.count(F.lit(1)).alias("payments"), ((F.max(t) - F.min(t)) / 3.6e9).alias("span_hours"), F.sum(amount).alias("total_amount")
    )
    accounts = dated.select(fto, account).distinct().groupBy(fto).agg(F.count(F.lit(1)).alias("accounts"))
    return out.join(accounts, fto).filter((F.col("payments") >= 2) & (F.col("span_hours") <= hours) & (F.col("accounts") >= 2))


def neighbourhood(edges: DataFrame, suspects: DataFrame, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes with distance, induced edges) within ``radius`` steps of the suspects."""
    both = undirected(edges)
    known = both.select(F.col("src").alias("id")).distinct()
    seen = durable(suspects.select("id").distinct().join(known, "id", "left_semi").withColumn("distance", F.lit(0)))
    edge = seen
    for step in range(1, radius + 1):
        near = edge.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id")).distinct()
        edge = durable(near.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(step)))
        seen = seen.unionByName(edge)
    inside = edges.join(seen.select(F.col("id").alias("src")), "src", "left_semi").join(seen.select(F.col("id").alias("dst")), "dst", "left_semi")
    return seen, inside


# -- cycles ----------------------------------------------------------------------------

def _trimmed(edges: DataFrame, by: list[str]) -> DataFrame:
    """``edges`` (written) without those at a vertex that lacks a way in or out, over and over; ``by`` names what parts the graph."""
    left, n = edges, edges.count()
    while n:
        ins, outs = left.select(*by, F.col("dst").alias("v")).distinct(), left.select(*by, F.col("src").alias("v")).distinct()
        live = ins.join(outs, [*by, "v"], "left_semi")
        nxt = durable(left.join(live.withColumnRenamed("v", "src"), [*by, "src"], "left_semi").join(live.withColumnRenamed("v", "dst"), [*by, "dst"], "left_semi"))
        m = nxt.count()
        if m == n:
            break
        left, n = nxt, m
    return left


def _spread(start: DataFrame, links: DataFrame, key: list[str]) -> DataFrame:
    """The smallest ``c`` that reaches each vertex ``v`` along ``links`` (src, dst); only what changed moves on.

    ``start`` holds (key, v, c), ``key`` columns are equal at both ends of a link.
    """
    known, news = start, start
    while not news.isEmpty():
        got = news.withColumnRenamed("v", "src").join(links, [*key, "src"]).groupBy(*key, F.col("dst").alias("v")).agg(F.min("c").alias("_c"))
        both = known.join(got, [*key, "v"], "full").withColumn("_new", F.coalesce(F.col("_c") < F.col("c"), F.col("c").isNull()))
        both = durable(both.select(*key, "v", F.when(F.col("_new"), F.col("_c")).otherwise(F.col("c")).alias("c"), "_new"))
        known, news = both.drop("_new"), both.filter("_new").drop("_new")
    return known


def strong_components(edges: DataFrame) -> DataFrame:
    """``v, component`` of every vertex on a directed cycle; a component is named by its smallest vertex.

    Vertices without way in or out are trimmed. Forward, every vertex takes the smallest
    vertex that reaches it as colour; backward from the vertex that names a colour, what
    is met within the colour is a component. The others go on with the links inside
    their colour, since a component never crosses colours. Each round names at least one
    component in every colour left.
    """
    left = durable(edges.select("src", "dst").filter("src != dst").distinct())
    found = left.select(F.col("src").alias("v"), F.col("src").alias("component")).limit(0)
    while True:
        left = _trimmed(left, [])
        if left.isEmpty():
            return found
        vertices = left.select(F.col("src").alias("v")).distinct()  # after trimming every vertex has a way out
        colour = _spread(durable(vertices.withColumn("c", F.col("v"))), left, [])
        tagged = left.join(colour.select(F.col("v").alias("src"), F.col("c").alias("k")), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("_k")), "dst")
        inside = durable(tagged.filter("k = _k").select("k", "src", "dst"))
        back = inside.select("k", F.col("dst").alias("src"), F.col("src").alias("dst"))
        seeds = durable(colour.filter("v = c").select(F.col("c").alias("k"), "v", "c"))
        met = _spread(seeds, back, ["k"]).select("v", F.col("c").alias("component"))
        found = durable(found.unionByName(met.join(inside.select(F.col("src").alias("v")).distinct(), "v", "left_semi")))
        left = durable(inside.join(met.select(F.col("v").alias("src")), "src", "left_anti").join(met.select(F.col("v").alias("dst")), "dst", "left_anti").select("src", "dst"))


def _walks(links: DataFrame, most: int) -> list[DataFrame]:
    """Pairs ``first, last`` that 1, 2, .. ``most`` of the ``links`` (src, dst) lead through, by larger vertices than ``first`` only."""
    levels = [links.filter("dst > src").select(F.col("src").alias("first"), F.col("dst").alias("last"))]
    for i in range(1, most):
        grown = levels[-1].join(links.select(F.col("src").alias("last"), F.col("dst").alias("_next")), "last").filter(F.col("_next") > F.col("first"))
        grown = grown.select("first", F.col("_next").alias("last"))
        levels.append(grown if i == most - 1 else durable(grown))  # the longest are read once
    return levels


def _way_back(links: DataFrame, walks: list[DataFrame], ends: list[DataFrame]) -> list[DataFrame]:
    """The links on ``walks`` to ``ends`` (pairs ``first, last``, by the length of the walk): ``first, src, dst, amount`` of each step."""
    steps, wanted = [], ends[-1]
    for i in range(len(ends) - 1, -1, -1):
        step = wanted.join(links.withColumnRenamed("dst", "last"), "last").filter(F.col("src") > F.col("first") if i else F.col("src") == F.col("first"))
        step = durable(step.select("first", "src", F.col("last").alias("dst"), "amount"))
        steps.insert(0, step)
        if i:
            wanted = step.select("first", F.col("src").alias("last")).unionByName(ends[i - 1]).distinct()
            # half way back, what is no way from ``first`` is left
            wanted = durable(wanted.join(walks[i - 1], ["first", "last"], "left_semi") if i == len(ends) // 2 else wanted)
    return steps


def _paths(steps: list[DataFrame], behind: bool) -> list[DataFrame]:
    """Simple paths of 1, 2, .. links by ``steps``; those ``behind`` grow in front, and leave the first vertex out."""
    amount = F.col("amount")
    start = F.array("dst") if behind else F.array("src", "dst")
    out = [steps[0].select("first", F.col("dst").alias("last"), start.alias("path"), amount.alias("_sum"), amount.alias("_min"))]
    for step in steps[1:]:
        grown = out[-1].join(step.withColumnRenamed("src", "last"), ["first", "last"]).filter(~F.array_contains("path", F.col("dst")))
        one = F.array("dst")
        out.append(durable(grown.select(
            "first", F.col("dst").alias("last"), (F.concat(one, "path") if behind else F.concat("path", one)).alias("path"),
            (F.col("_sum") + amount).alias("_sum"), F.least("_min", amount).alias("_min"),
        )))
    return out


def cycles(edges: DataFrame, shortest: int = 3, longest: int = 8) -> DataFrame:
    """All simple directed cycles of bounded length: ``path, length, total_amount, min_amount``.

    A cycle starts at its smallest vertex and is the meeting of two halves of at most
    ``longest / 2`` (rounded up) links, one forward from that vertex and one backward. First
    only the ends of such halves are listed, as pairs of vertices; where a pair is the end of
    both, its walks are followed back link by link, and paths with their vertices grow along
    these links alone. The number of jobs follows ``longest`` only, not the shape of the graph.
    """
    core = durable(edges.filter("src != dst").groupBy("src", "dst").agg(F.max("amount").alias("amount")))
    turned = core.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "amount")
    sizes = [((n + 1) // 2, n // 2) for n in range(max(2, shortest), longest + 1)]
    most = [max((s[side] for s in sizes), default=1) for side in (0, 1)]
    # bit i stands for an end of i links ahead, bit 32 + j for one of j links behind
    ahead, behind = _walks(core.select("src", "dst"), most[0]), _walks(turned.select("src", "dst"), most[1])
    bits = {i: ahead[i - 1] for i in {i for i, _ in sizes}} | {32 + j: behind[j - 1] for j in {j for _, j in sizes}}
    marked = [walk.withColumn("_bits", F.lit(1 << bit).cast("long")) for bit, walk in bits.items()]
    both = functools.reduce(DataFrame.unionByName, marked)
    closes = lambda i, j: F.col("_bits").bitwiseAND(F.lit((1 << i) | (1 << (32 + j)))) == F.lit((1 << i) | (1 << (32 + j)))
    either = lambda some: functools.reduce(lambda a, b: a | b, some, F.lit(False))
    met = durable(both.groupBy("first", "last").agg(F.bit_or("_bits").alias("_bits")).filter(either([closes(i, j) for i, j in sizes])))
    ends = [[met.filter(either([closes(*s) for s in sizes if s[side] == i])).select("first", "last") for i in range(1, most[side] + 1)] for side in (0, 1)]
    out = _paths(_way_back(core, ahead, ends[0]), False)
    back = _paths(_way_back(turned, behind, ends[1]), True)
    found = None
    for size, (i, j) in enumerate(sizes, max(2, shortest)):
        rest = back[j - 1].select("first", "last", F.slice("path", 2, size).alias("_rest"), F.col("_sum").alias("_s"), F.col("_min").alias("_m"))
        joined = out[i - 1].join(rest, ["first", "last"]).filter(~F.arrays_overlap("path", "_rest"))
        closed = joined.select(F.concat("path", "_rest").alias("path"), F.lit(size).alias("length"), (F.col("_sum") + F.col("_s")).alias("total_amount"), F.least("_min", "_m").alias("min_amount"))
        found = closed if found is None else found.unionByName(closed)
    return found


def distinct_cycles(found: DataFrame) -> DataFrame:
    """One cycle per set of vertices."""
    first = F.min_by(F.struct("path", "total_amount"), "path").alias("_f")
    return found.groupBy(F.array_sort("path").alias("members"), "length").agg(first).select("_f.*", "length")


def official_cycles(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cycles through an official or a panchayat, with a confidence."""
    typed = found.select("*", F.explode("path").alias("id")).join(nodes.select("id", "node_type"), "id").groupBy(*found.columns).agg(
        F.count_if(F.col("node_type") == "official").alias("officials"), F.count_if(F.col("node_type") == "panchayat").alias("panchayats")
    )
    conf = F.when(F.col("officials") > 0, 0.7).otherwise(0.5) + F.when(F.col("length") <= 4, 0.1).otherwise(0.0)
    return typed.filter((F.col("officials") > 0) | (F.col("panchayats") > 0)).withColumn("confidence", conf)


# -- centrality --------------------------------------------------------------------------

def eigenvector(edges: DataFrame, max_rounds: int = 500, tolerance: float = 1e-6, stride: int = 5) -> DataFrame:
    """Eigenvector centrality by power iteration on A + I; zeros when it does not settle.

    ``stride`` multiplications run as one job; only then the vector is scaled and
    the last two iterates are compared.
    """
    plain = durable(undirected(edges))
    ids = plain.select(F.col("src").alias("id")).distinct()
    # the identity part of A + I as one loop per vertex
    both = durable(plain.unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))).repartition("src"))
    n = ids.count()
    if n == 0:
        return ids.withColumn("eigenvector", F.lit(0.0))
    x = ids.withColumn("y", F.lit(1.0 / n))
    for _ in range(0, max_rounds, stride):
        for _ in range(stride):
            pushed = both.join(x.select(F.col("id").alias("src"), "y"), "src")
            x = pushed.groupBy(F.col("dst").alias("id")).agg(
                F.sum("y").alias("y"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("y"))).alias("x")
            )
        x = durable(x)
        ny, nx = x.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))), F.sqrt(F.sum(F.col("x") * F.col("x")))).first()
        moved = x.agg(F.sum(F.abs(F.col("y") / ny - F.col("x") / nx))).first()[0]
        x = x.select("id", (F.col("y") / ny).alias("y"))
        if moved < n * tolerance:
            return x.withColumnRenamed("y", "eigenvector")
    return x.select("id", F.lit(0.0).alias("eigenvector"))


def _dependencies(both: DataFrame, pivots: DataFrame) -> DataFrame:
    """Brandes' dependencies on each vertex, summed over the pivots: ``v, s1, s2`` (plain and squared).

    Breadth-first search from all pivots at once, keyed by (pivot, vertex), then back level
    by level. A neighbour of a level is in it, the one before or the next, so only two are
    looked at.
    """
    levels = [durable(pivots.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma")))]
    while True:
        met = levels[-1].withColumnRenamed("v", "src").join(both, "src").groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        for known in levels[-2:]:
            met = met.join(known.select("s", "v"), ["s", "v"], "left_anti")
        met = durable(met)
        if met.isEmpty():
            break
        levels.append(met)
    delta = levels.pop().withColumn("delta", F.lit(0.0))
    total = None
    while levels:
        part = delta.groupBy("v").agg(F.sum("delta").alias("s1"), F.sum(F.col("delta") * F.col("delta")).alias("s2"))
        total = part if total is None else total.unionByName(part)
        flow = (
            delta.withColumnRenamed("v", "dst").join(both, "dst").groupBy("s", F.col("src").alias("v"))
            .agg(F.sum((1 + F.col("delta")) / F.col("sigma")).alias("_f"))
        )
        mine = levels.pop().join(flow, ["s", "v"], "left")
        delta = durable(mine.select("s", "v", "sigma", (F.col("sigma") * F.coalesce("_f", F.lit(0.0))).alias("delta")))
    if total is None:
        return delta.select("v", F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2")).limit(0)
    return total.groupBy("v").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def _held(both: DataFrame) -> Broadcast:
    """(vertices, first link of each and one more, other end of each link) for every task."""
    ids, a, b = _places(both.select("src", "dst").toArrow())
    return both.sparkSession.sparkContext.broadcast((ids, np.searchsorted(a, np.arange(len(ids) + 1)), b.astype(np.int32)))


#: States that a task keeps of up to 16 pivots together, and links it looks at at once.
_STATES = 1 << 21
_LOOKED_AT = 1 << 15


def _held_dependencies(held: Broadcast, pivots: DataFrame) -> DataFrame:
    """``_dependencies`` where each task holds the graph and searches from some of the pivots."""

    def links_of(rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each link of the rows, where the links of each row start among them)."""
        sizes = begin[rows + 1] - begin[rows]
        first = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) + np.repeat(begin[rows] - first, sizes), first

    def summed(values: np.ndarray, rows: np.ndarray, begin: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The sum of ``values`` over the neighbours of each of the rows, other rows 0; every vertex has a neighbour."""
        out, low = np.zeros_like(values), 0
        ends = np.cumsum(begin[rows + 1] - begin[rows])
        while low < len(rows):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _LOOKED_AT, "right")))
            links, first = links_of(rows[low:high], begin)
            out[rows[low:high]] = np.add.reduceat(values[other[links]], first, axis=0)
            low = high
        return out

    def pushed(values: np.ndarray, rows: np.ndarray, begin: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The same from the side of the rows, which hold all values but 0."""
        links, _ = links_of(rows, begin)
        to, source = other[links], np.repeat(rows, begin[rows + 1] - begin[rows])
        order = np.argsort(to, kind="stable")
        to = to[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        out = np.zeros_like(values)
        out[to[first]] = np.add.reduceat(values[source[order]], first, axis=0)
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, begin, other = held.value
        n = len(ids)
        together = max(1, min(16, _STATES // n))
        s1, s2, any_pivot = np.zeros(n), np.zeros(n), False
        for batch in batches:
            places = pc.index_in(batch.column("id"), value_set=ids).to_numpy()
            for start in range(0, len(places), together):
                some = places[start : start + together]
                any_pivot, each = True, np.arange(len(some))
                level = np.full((n, len(some)), -1, np.int16 if n < 1 << 15 else np.int32)
                sigma = np.zeros((n, len(some)))
                level[some, each], sigma[some, each] = 0, 1.0
                depth, front, rows = 0, sigma.copy(), np.unique(some)
                while True:
                    if (begin[rows + 1] - begin[rows]).sum() * 8 < len(other):
                        met = pushed(front, rows, begin, other)
                    else:
                        met = summed(front, np.flatnonzero((level < 0).any(axis=1)), begin, other)
                    met[level >= 0] = 0.0
                    new = met > 0
                    if not new.any():
                        break
                    depth += 1
                    level[new] = depth
                    sigma += met
                    front, rows = met, np.flatnonzero(new.any(axis=1))
                delta = np.zeros_like(sigma)
                for d in range(depth, 1, -1):
                    above = level == d - 1
                    share = np.zeros_like(sigma)
                    np.divide(1 + delta, sigma, out=share, where=level == d)
                    flow = summed(share, np.flatnonzero(above.any(axis=1)), begin, other)
                    np.multiply(sigma, flow, out=delta, where=above)
                s1 += delta.sum(axis=1)
                s2 += (delta * delta).sum(axis=1)
        if any_pivot:
            yield pa.record_batch([ids, pa.array(s1), pa.array(s2)], names=["v", "s1", "s2"])

    spark = pivots.sparkSession
    name = pivots.schema["id"].dataType.simpleString()
    dealt = pivots.select("id").repartition(spark.sparkContext.defaultParallelism, F.xxhash64("id"))
    return dealt.mapInArrow(search, f"v {name}, s1 double, s2 double").groupBy("v").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def betweenness(edges: DataFrame, pivots: int | None = None, batch: int = 256, top: int | None = None, risk: float = 0.05) -> DataFrame:
    """``id, betweenness, error``: normalised betweenness of an undirected graph, from random pivots.

    Pivots are drawn without replacement, in batches of about ``batch`` by a hash of the
    vertex; a batch keeps (pivots of the batch) x (vertices) states and only two sums a
    vertex outlive it. It ends when all vertices have been pivots (exact, error 0), when
    the ``top`` vertices stand apart from all others within their errors, or, if given,
    after ``pivots`` pivots. With probability 1 - ``risk`` no true value is further than
    ``error`` from its estimate (empirical Bernstein-Serfling bound, all vertices and
    batches together). A graph of at most ``_WHOLE_LINKS`` links is held by every task,
    larger ones are searched by joins.
    """
    both = durable(undirected(edges))
    ids = durable(both.select(F.col("src").alias("id")).distinct().withColumn("_h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)))
    n = ids.count()
    total, k, turn = None, 0, 0
    scale = n / ((n - 1) * (n - 2)) if n > 2 else 0.0
    out = ids.select("id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error"))
    links = both.count()
    held = _held(both) if n > 2 and links <= _WHOLE_LINKS else None
    while n > 2 and k < n and (pivots is None or k < pivots):
        drawn = durable(ids.filter((F.col("_h") >= turn * batch / n) & (F.col("_h") < (turn + 1) * batch / n)))
        turn, size = turn + 1, drawn.count()
        if not size:
            continue
        k += size
        part = _dependencies(both, drawn) if held is None else _held_dependencies(held, drawn)
        total = durable(part if total is None else total.unionByName(part).groupBy("v").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2")))
        rho = 1 - (k - 1) / n if k <= n / 2 else (1 - k / n) * (1 + 1 / k)
        log = math.log(5 * n * turn * (turn + 1) / risk)
        mean = F.coalesce(F.col("s1"), F.lit(0.0)) / k
        spread = F.sqrt(F.greatest(F.coalesce(F.col("s2"), F.lit(0.0)) / k - mean * mean, F.lit(0.0)))
        error = spread * math.sqrt(2 * rho * log / k) + (7 / 3 + 3 / math.sqrt(2)) * (n - 2) * log / k if k < n else F.lit(0.0)
        out = ids.select("id").join(total.withColumnRenamed("v", "id"), "id", "left").select("id", (mean * scale).alias("betweenness"), (error * scale).alias("error"))
        if top is not None and k < n and _apart(out, top):
            break
    return out


def _apart(found: DataFrame, top: int) -> bool:
    """Whether the ``top`` values are above all others within their errors."""
    found = durable(found)
    lead = found.orderBy(F.col("betweenness").desc(), "id").limit(top)
    low = lead.agg(F.min(F.col("betweenness") - F.col("error"))).first()[0]
    high = found.join(lead.select("id"), "id", "left_anti").agg(F.max(F.col("betweenness") + F.col("error"))).first()[0]
    return high is None or low >= high


def bridges(edges: DataFrame, top: int = 20, pivots: int | None = None, batch: int = 256) -> DataFrame:
    """Vertices with the highest betweenness, its error, and their degree."""
    b = betweenness(edges, pivots, batch, top).join(degrees(edges).select("id", "degree"), "id")
    # values that differ in their last bits only are ties
    return b.orderBy(F.round("betweenness", 10).desc(), "id").limit(top)


# -- communities ---------------------------------------------------------------------------

def modularity(weighted: DataFrame, membership: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of a membership (``v, c``) on symmetric weighted edges (``src, dst, w``)."""
    m2 = weighted.agg(F.sum("w")).first()[0] or 0.0
    if not m2:
        return 0.0
    tagged = weighted.join(membership.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(
        membership.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst")
    inner = tagged.groupBy("cs").agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("k"))
    return inner.agg(F.sum(F.col("i") / m2 - resolution * F.pow(F.col("k") / m2, F.lit(2)))).first()[0]


def connected(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``v, c`` for each of ``vertices`` (``v``): the smallest vertex joined to it by ``edges``."""
    parts = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return durable(vertices.join(parts, "v", "left").select("v", F.coalesce("component", "v").alias("c")))


def communities(edges: DataFrame, resolution: float = 1.0, gain: float = 1e-4, patience: int = 4) -> DataFrame:
    """Communities of an undirected graph by modularity, each connected: ``id, community``.

    Vertices move at the same time, but only one random half per round, so that
    neighbours do not swap for ever. After each level a community is split into its
    connected parts (a move can cut the one it leaves), parts become the vertices of the
    next level, and start there in their community, so that what was split can part for
    good. A level ends when ``patience`` rounds raised modularity by less than ``gain``,
    the whole when a level does. A graph of at most ``_WHOLE_LINKS`` links goes through
    the same steps in one task.
    """
    graph = durable(undirected(edges).withColumn("w", F.lit(1.0)))
    m2, links = graph.agg(F.sum("w"), F.count(F.lit(1))).first()
    final = graph.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    if not m2:
        return final
    if links <= _WHOLE_LINKS:
        return _whole_communities(graph, resolution, gain, patience)
    node = durable(final.select("id", F.col("id").alias("v")))
    member, best = durable(node.select("v", F.col("v").alias("c")).distinct()), -1.0
    while True:
        member, q = _local_moves(graph, member, m2, resolution, gain, patience)
        tagged = graph.join(member.select(F.col("v").alias("src"), F.col("c").alias("_s")), "src").join(member.select(F.col("v").alias("dst"), F.col("c").alias("_d")), "dst")
        parts = connected(durable(tagged.filter("_s = _d AND src != dst").select("src", "dst")), member.select("v"))
        node = durable(node.join(parts, "v").select("id", F.col("c").alias("v")))
        if q <= best + gain:
            return node.select("id", F.col("v").alias("community"))
        best = q
        # the parts are named by one of their vertices, and keep that one's community
        named = durable(parts.withColumnRenamed("c", "_part"))
        member = durable(member.join(named, "v").groupBy(F.col("_part").alias("v")).agg(F.min("c").alias("c")))
        graph = durable(
            graph.join(named.select(F.col("v").alias("src"), F.col("_part").alias("_s")), "src").join(named.select(F.col("v").alias("dst"), F.col("_part").alias("_d")), "dst")
            .groupBy(F.col("_s").alias("src"), F.col("_d").alias("dst")).agg(F.sum("w").alias("w"))
        )


def _places(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vertices ascending, place of each ``src``, of each ``dst``) of the links, which are put in order of both."""
    src, dst = (table.column(c).combine_chunks() for c in ("src", "dst"))
    ids = pc.unique(pa.concat_arrays([src, dst]))
    ids = ids.take(pc.sort_indices(ids))
    a, b = (pc.index_in(x, value_set=ids).to_numpy().astype(np.int64) for x in (src, dst))
    order = np.lexsort((b, a))
    return ids, a[order], b[order]


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex joined to each of ``n`` by the links ``a, b``."""
    least = np.arange(n)
    while True:
        x, y = least[a], least[b]
        low, nxt = np.minimum(x, y), least.copy()
        np.minimum.at(nxt, x, low)
        np.minimum.at(nxt, y, low)
        while not np.array_equal(up := nxt[nxt], nxt):
            nxt = up
        if np.array_equal(nxt, least):
            return least
        least = nxt


def _whole_communities(graph: DataFrame, resolution: float, gain: float, patience: int) -> DataFrame:
    """``communities`` of a graph that one task holds."""

    def moved(a: np.ndarray, b: np.ndarray, w: np.ndarray, start: np.ndarray, m2: float) -> tuple[np.ndarray, float]:
        n = len(start)
        k = np.bincount(a, w, n)
        apart = a != b
        x, y, z = a[apart], b[apart], w[apart]

        def value(c: np.ndarray) -> float:
            same = c[a] == c[b]
            return float((np.bincount(c[a][same], w[same], n) / m2 - resolution * (np.bincount(c, k, n) / m2) ** 2).sum())

        c = start.copy()
        best, top, idle, r = c, value(c), 0, 0
        while idle < patience:
            turn = np.random.default_rng(r).random(n) < 0.5
            total = np.bincount(c, k, n)
            mine = np.flatnonzero(turn)
            pull = turn[x]
            key = np.concatenate([x[pull] * n + c[y[pull]], mine * n + c[mine]])
            keys, of = np.unique(key, return_inverse=True)
            inner = np.bincount(of, np.concatenate([z[pull], np.zeros(len(mine))]))
            v, to = keys // n, keys % n
            own = to == c[v]
            score = inner - resolution * k[v] * (total[to] - np.where(own, k[v], 0.0)) / m2
            order = np.lexsort((to, score, v))
            last = order[np.append(np.flatnonzero(np.diff(v)), len(v) - 1)] if len(v) else order
            now = np.zeros(n)
            now[v[own]] = score[own]
            last = last[score[last] > now[v[last]] + 1e-12]
            c = c.copy()
            c[v[last]] = to[last]
            q, r = value(c), r + 1
            idle = 0 if q > top + gain else idle + 1
            if q > top:
                best, top = c, q
        return best, top

    def solve(table: pa.Table) -> pa.Table:
        ids, a, b = _places(table)
        w, m2 = np.ones(len(a)), float(len(a))
        node, member, best = np.arange(len(ids)), np.arange(len(ids)), -1.0
        least = np.arange(len(ids))  # the first vertex of each part, which names it
        while True:
            member, q = moved(a, b, w, member, m2)
            inside = member[a] == member[b]
            parts = _joined(len(member), a[inside], b[inside])
            roots, to = np.unique(parts, return_inverse=True)
            node, least = to[node], least[roots]
            if q <= best + gain:
                return pa.table([ids, ids.take(pa.array(least[node]))], names=["id", "community"])
            best = q
            # a part keeps its community, named anew by the first of its parts
            _, first, kept = np.unique(member[roots], return_index=True, return_inverse=True)
            member = first[kept]
            key, of = np.unique(to[a] * len(roots) + to[b], return_inverse=True)
            a, b, w = key // len(roots), key % len(roots), np.bincount(of, w)

    name = graph.schema["src"].dataType.simpleString()
    return durable(graph.select("src", "dst", F.lit(0).alias("_all")).groupBy("_all").applyInArrow(solve, f"id {name}, community {name}"))


def _local_moves(graph: DataFrame, start: DataFrame, m2: float, resolution: float, gain: float, patience: int) -> tuple[DataFrame, float]:
    """The best membership met from ``start`` (``v, c``) on, and its modularity."""
    strength = durable(graph.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k")))
    member = durable(strength.join(start, "v"))
    links = graph.filter("src != dst")
    best, top, idle, r = member.select("v", "c"), modularity(graph, start, resolution), 0, 0
    while idle < patience:
        total = member.groupBy("c").agg(F.sum("k").alias("_tot"))
        turn = member.filter(F.pmod(F.xxhash64(F.col("v"), F.lit(r)), F.lit(2)) == 0).select("v", "k", F.col("c").alias("_own"))
        pull = (
            links.join(member.select(F.col("v").alias("dst"), "c"), "dst").join(turn.select(F.col("v").alias("src")), "src", "left_semi")
            .groupBy(F.col("src").alias("v"), "c").agg(F.sum("w").alias("_in"))
        )
        # staying is an option even without a link to the own community
        stay = turn.select("v", F.col("_own").alias("c"), F.lit(0.0).alias("_in"))
        options = pull.unionByName(stay).groupBy("v", "c").agg(F.sum("_in").alias("_in")).join(turn, "v").join(total, "c")
        own = F.col("c") == F.col("_own")
        rest = F.when(own, F.col("_tot") - F.col("k")).otherwise(F.col("_tot"))
        scored = options.withColumn("_s", F.col("_in") - resolution * F.col("k") * rest / m2)
        choice = scored.groupBy("v").agg(
            F.max_by("c", F.struct("_s", "c")).alias("_to"), F.max("_s").alias("_top"), F.max(F.when(own, F.col("_s"))).alias("_now")
        ).filter(F.col("_top") > F.col("_now") + 1e-12)
        member = durable(member.join(choice.select("v", "_to"), "v", "left").select("v", "k", F.coalesce("_to", "c").alias("c")))
        q, r = modularity(graph, member.select("v", "c"), resolution), r + 1
        idle = 0 if q > top + gain else idle + 1
        if q > top:
            best, top = member.select("v", "c"), q
    return best, top


def community_profile(membership: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Size, node types, inner edges and inner amount of every community."""
    tag = membership.select(F.col("id").alias("src"), F.col("community").alias("_a"))
    tag2 = membership.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
    inner = edges.join(tag, "src").join(tag2, "dst").filter("_a = _b").groupBy(F.col("_a").alias("community")).agg(
        F.count(F.lit(1)).alias("internal_edges"), F.sum("amount").alias("total_amount")
    )
    size = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    out = size.join(inner, "community", "left").fillna(0, ["internal_edges", "total_amount"])
    if nodes is not None:
        kinds = membership.join(nodes, "id").groupBy("community").agg(F.array_sort(F.collect_set("node_type")).alias("node_types"))
        out = out.join(kinds, "community", "left")
    return out
