"""Exact overlap of polygons against shapes computed by hand."""

import math
import random

import pytest

from tallyscope.operators import places


def ring(*points):
    return [[float(x), float(y)] for x, y in (*points, points[0])]


SQUARE = [ring((0, 0), (4, 0), (4, 4), (0, 4))]
CASES = [
    (SQUARE, [ring((2, 2), (6, 2), (6, 6), (2, 6))], 25.0),
    (SQUARE, [ring((0, 0), (4, 0), (0, 4))], 100.0),
    # a diamond over a square: the square keeps 16 - 4 corners of 0.5
    ([ring((-1, 2), (2, -1), (5, 2), (2, 5))], SQUARE, 100 * (16 - 4 * 0.5) / 16),
    # an L against a square, and a hole that the other polygon covers
    ([ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))], [ring((0, 0), (2, 0), (2, 2), (0, 2))], 75.0),
    ([SQUARE[0], ring((1, 1), (3, 1), (3, 3), (1, 3))], [ring((0, 0), (2, 0), (2, 4), (0, 4))], 100 * 6 / 8),
    (SQUARE, [ring((9, 9), (10, 9), (10, 10))], 0.0),
    (SQUARE, [ring((1, 1), (2, 1), (3, 1))], 0.0),
]


def test_overlap_is_exact(spark):
    rows = [(k, a, b) for k, (a, b, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, a array<array<array<double>>>, b array<array<array<double>>>")
    got = {r["k"]: r["overlap_pct"] for r in places.polygon_overlap(df, "k", "a", "b").collect()}
    for k, (_, _, want) in enumerate(CASES):
        assert got[k] == pytest.approx(want, abs=1e-9), k


def star(rng, x, y, n=9):
    """A ring that is not convex."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return ring(*[(x + r * math.cos(t), y + r * math.sin(t)) for t in turns for r in [rng.uniform(0.05, 1.5)]])


def test_points_meet_polygons_through_their_cells(spark):
    rng = random.Random(6)
    shapes = [[star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3))] for _ in range(12)]
    shapes += [SQUARE, [SQUARE[0], ring((1, 1), (3, 1), (3, 3), (1, 3))], SQUARE, [ring((0.05, 0.05), (0.07, 0.05), (0.06, 0.07))], [ring((-2, -2), (2, 2), (2.01, 2), (-1.99, -2))]]
    spots = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(3000)] + [(round(rng.uniform(-4, 4), 1) + 0.05, round(rng.uniform(-4, 4), 1)) for _ in range(500)]

    def inside(rings, x, y):
        hits = 0
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:]):
                hits += (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay)
        return hits % 2 == 1

    points = spark.createDataFrame([(i, *p) for i, p in enumerate([*spots, (None, 1.0)])], "i int, lon double, lat double")
    polygons = spark.createDataFrame([*enumerate(shapes), (99, None)], "k int, rings array<array<array<double>>>")
    want = {(i, k) for i, (x, y) in enumerate(spots) for k, r in enumerate(shapes) if inside(r, x, y)}
    for cell in (0.1, 0.7, 20.0):
        got = [(r["i"], r["k"]) for r in places.points_in_polygons(points, polygons, cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want, cell


def test_cells_hold_only_their_own_edges(spark):
    circle = ring(*[(math.cos(t / 1000 * math.pi), math.sin(t / 1000 * math.pi)) for t in range(2000)])
    cells = places.cover(spark.createDataFrame([("c", [circle])], "s string, rings array<array<array<double>>>"), "s", "rings", 0.01).collect()
    assert abs(len(cells) - math.pi * 1e4) < 1000
    # twice an edge at most for each border that it passes, never a ring in a cell
    assert max(len(r["_edges"]) for r in cells) < 20
    assert sum(len(r["_edges"]) for r in cells) < 3 * 2000
    assert all(r["_inside"] for r in cells if not r["_edges"])


def test_edges_as_columns_tell_what_lists_tell(spark, monkeypatch):
    rng = random.Random(8)
    shapes = [[star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), n)] for n in (3, 4, 7)] + [SQUARE]
    points = spark.createDataFrame([(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(2000)], "i int, lon double, lat double")
    polygons = spark.createDataFrame(list(enumerate(shapes)), "k int, rings array<array<array<double>>>")
    found = []
    for flat in (-1, 1, 4):
        monkeypatch.setattr(places, "_FLAT", flat)
        found.append({(r["i"], r["k"]) for r in places.points_in_polygons(points, polygons, cell=0.5).collect()})
    assert found[0] and found[0] == found[1] == found[2]
