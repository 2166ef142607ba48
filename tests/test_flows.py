"""Cycles, components, betweenness and communities against sequential code."""

import random

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import graph


def table(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, amount double")


#: Three components in a row (a cycle, a cycle, two vertices), ways in and out of them.
TAIL = [(100, 101, 5), (101, 102, 1), (102, 100, 2), (103, 100, 3), (102, 104, 2), (104, 105, 1), (105, 106, 1), (106, 104, 1), (106, 107, 1), (107, 108, 2), (108, 107, 1)]


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(1, 99)) for _ in range(m)] + TAIL


def brute_cycles(edges, low, high):
    best = {}
    for a, b, w in edges:
        if a != b:
            best[a, b] = max(w, best.get((a, b), 0))
    out = {}

    def go(path, total, least):
        for (a, b), w in best.items():
            if a != path[-1]:
                continue
            if b == path[0] and low <= len(path) <= high:
                out[tuple(path)] = (total + w, min(least, w))
            elif b > path[0] and b not in path and len(path) < high:
                go([*path, b], total + w, min(least, w))

    for v in {a for a, _ in best}:
        go([v], 0, 10**9)
    return out


@pytest.mark.parametrize("n, m, low, high", [(12, 25, 3, 8), (5, 30, 2, 4)])
def test_cycles_and_components(spark, n, m, low, high):
    edges = random_edges(n, m, n)
    got = {tuple(r["path"]): (r["total_amount"], r["min_amount"]) for r in graph.cycles(table(spark, edges), low, high).collect()}
    assert got == brute_cycles(edges, low, high)
    reach = {v: {v} for e in edges for v in e[:2]}
    for _ in reach:
        for a, b, _ in edges:
            reach[a] |= reach[b]
    want = {v: min(u for u in reach if u in reach[v] and v in reach[u]) for v in reach}
    sizes = {c: sum(x == c for x in want.values()) for c in want.values()}
    got = {r["v"]: r["component"] for r in graph.strong_components(table(spark, edges)).collect()}
    assert got == {v: c for v, c in want.items() if sizes[c] > 1}


def test_cycles_of_nothing(spark):
    assert graph.cycles(table(spark, [])).count() == 0
    assert graph.cycles(table(spark, [(1, 1, 1), (1, 2, 1), (2, 3, 1)])).count() == 0


def test_cycles_of_a_long_row_need_few_tables(spark, monkeypatch):
    # 150 rings in a row: what reaches along it must not cost a table for each step
    row = [(3 * i + a, 3 * i + b, 1) for i in range(150) for a, b in ((0, 1), (1, 2), (2, 0), (2, 3), (3, 2))]
    written, durable = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: written.append(1) or durable(df))
    found = graph.cycles(table(spark, row), 3, 4).collect()
    assert sorted(tuple(r["path"]) for r in found) == [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(150)]
    assert len(written) < 30


def brute_betweenness(edges):
    near = {}
    for a, b, _ in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        dist, ways, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for u in near[v]:
                if u not in dist:
                    dist[u], ways[u] = dist[v] + 1, 0.0
                    order.append(u)
                if dist[u] == dist[v] + 1:
                    ways[u] += ways[v]
        flow = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[v]:
                if dist[u] == dist[v] + 1:
                    flow[v] += ways[v] / ways[u] * (1 + flow[u])
            if v != s:
                total[v] += flow[v]
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_of_all_pivots_is_exact(spark):
    edges = random_edges(40, 70, 5)
    got = {r["id"]: (r["betweenness"], r["error"]) for r in graph.betweenness(table(spark, edges), batch=30).collect()}
    want = brute_betweenness(edges)
    assert got.keys() == want.keys()
    assert all(got[v] == (pytest.approx(want[v]), 0.0) for v in want)


def test_betweenness_of_some_pivots_is_within_its_error(spark):
    # two clusters that meet in one vertex: it stands apart from the others long before all are pivots
    rng = random.Random(2)
    edges = [(rng.randrange(1, 200), rng.randrange(1, 200), 1) for _ in range(900)] + [(rng.randrange(200, 400), rng.randrange(200, 400), 1) for _ in range(900)]
    edges += [(0, v, 1) for v in (3, 50, 120, 230, 290, 370)]
    want = brute_betweenness(edges)
    rows = graph.betweenness(table(spark, edges), pivots=150, batch=75).collect()
    assert all(abs(r["betweenness"] - want[r["id"]]) <= r["error"] for r in rows) and rows[0]["error"] > 0
    top = graph.bridges(table(spark, edges), 1, batch=150).collect()
    assert [r["id"] for r in top] == [0]


def test_planted_communities(spark):
    groups, size = 60, 40
    v = spark.range(groups * size).withColumn("g", F.floor(F.col("id") / size))
    inner = v.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"), "g").select(
        "src", (F.col("g") * size + F.pmod(F.xxhash64("src", "k"), F.lit(size))).alias("dst"))
    outer = v.select(F.col("id").alias("src"), F.pmod(F.xxhash64("id"), F.lit(groups * size)).alias("dst")).filter("src % 2 = 0")
    edges = inner.unionByName(outer).withColumn("amount", F.lit(1.0))
    got = graph.communities(edges).withColumn("g", F.floor(F.col("id") / size))
    pure = got.groupBy("g", "community").count().groupBy("g").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    assert pure.agg(F.sum("most") / F.sum("all")).first()[0] > 0.95
    assert 35 <= got.select("community").distinct().count() <= 85


def test_communities_are_connected(spark):
    edges = table(spark, [(a, b, 1) for a, b, _ in random_edges(300, 420, 8)])
    found = graph.communities(edges)
    tagged = edges.join(found.select(F.col("id").alias("src"), F.col("community").alias("s")), "src").join(found.select(F.col("id").alias("dst"), F.col("community").alias("d")), "dst")
    parts = graph.connected(tagged.filter("s = d and src != dst"), found.select(F.col("id").alias("v")))
    assert parts.select("c").distinct().count() == found.select("community").distinct().count()
