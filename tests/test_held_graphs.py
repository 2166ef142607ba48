"""Graphs of few links: betweenness and communities in tasks that hold the graph, as the joins have it."""

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import graph

from .test_flows import brute_betweenness, random_edges, table


def refuse(*_, **__):
    raise AssertionError("a graph of few links needs no joins")


def test_held_betweenness(spark, monkeypatch):
    edges = random_edges(60, 90, 4) + [(1000, 1001, 1), (1001, 1002, 1)]
    want = brute_betweenness(edges)
    df = table(spark, edges)
    with monkeypatch.context() as m:
        m.setattr(graph, "_WHOLE_LINKS", 0)
        joined = {r["id"]: (r["betweenness"], r["error"]) for r in graph.betweenness(df, pivots=30, batch=15).collect()}
    monkeypatch.setattr(graph, "_dependencies", refuse)
    monkeypatch.setattr(graph, "_LOOKED_AT", 7)
    held = {r["id"]: (r["betweenness"], r["error"]) for r in graph.betweenness(df, pivots=30, batch=15).collect()}
    assert held.keys() == joined.keys() and all(held[v] == pytest.approx(joined[v]) for v in held)
    exact = {r["id"]: r["betweenness"] for r in graph.betweenness(df).collect()}
    assert exact.keys() == want.keys() and all(exact[v] == pytest.approx(want[v]) for v in want)


def test_held_communities(spark, monkeypatch):
    edges = [(10 * g + i, 10 * g + j, 1) for g in range(12) for i in range(10) for j in range(i) if (i * 7 + j * 3 + g) % 4]
    edges += [(10 * g, (10 * g + 10) % 120, 1) for g in range(12)] + [(500, 501, 1)]
    monkeypatch.setattr(graph, "_local_moves", refuse)
    df = table(spark, edges)
    found = graph.communities(df)
    parts = {}
    for r in found.collect():
        parts.setdefault(r["community"], set()).add(r["id"])
    # a community is named by its first vertex; the cliques are never cut
    assert all(min(p) == c for c, p in parts.items()) and {500, 501} in parts.values()
    assert all(any(set(range(10 * g, 10 * g + 10)) <= p for p in parts.values()) for g in range(12)) and len(parts) > 6
    both = graph.undirected(df).withColumn("w", F.lit(1.0))
    assert graph.modularity(both, found.select(F.col("id").alias("v"), F.col("community").alias("c"))) > 0.75
