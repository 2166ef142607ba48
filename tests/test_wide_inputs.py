"""Operators away from the benchmark tables: wide coordinates, large counts, fractions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.functions import scalar, tails
from tallyscope.operators import attendance, joins, photos, sequences

R = 6_371_000.0


def metres(a, b):
    (la, lo), (lb, lp) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def test_distance_join_at_poles_and_date_line(spark):
    rng = random.Random(1)

    def place():
        return rng.choice([
            (rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.uniform(88, 90), rng.uniform(-180, 180)), (-rng.uniform(85, 90), rng.uniform(-180, 180)),
            (rng.uniform(60, 62), rng.uniform(10, 14)), (rng.uniform(-10, 10), 180 - rng.uniform(0, 1)), (rng.uniform(-10, 10), rng.uniform(0, 1) - 180),
        ])

    points, sites = [place() for _ in range(400)], [place() for _ in range(300)]
    for radius in (20_000, 300_000, 4_000_000):
        got = joins.within_distance(
            spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point_id int, lat double, lon double"),
            spark.createDataFrame([(i, *p) for i, p in enumerate(sites)], "site_id int, site_lat double, site_lon double"), radius,
        ).select("point_id", "site_id").collect()
        want = {(i, j) for i, p in enumerate(points) for j, s in enumerate(sites) if metres(p, s) <= radius}
        assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("cap", [5, 40, 60, 85, 180])
def test_spread_of_many_places(spark, cap):
    rng = np.random.default_rng(cap)
    rows = []
    for key in range(12):
        axis = rng.standard_normal(3)
        axis /= np.linalg.norm(axis)
        while sum(r[0] == key for r in rows) < 90:
            v = rng.standard_normal(3)
            v /= np.linalg.norm(v)
            if math.degrees(math.acos(float(np.clip(v @ axis, -1, 1)))) <= cap:
                rows.append((key, math.degrees(math.asin(v[2])), math.degrees(math.atan2(v[1], v[0]))))
    got = attendance.max_spread(spark.createDataFrame(rows, "k int, la double, lo double"), ["k"], "la", "lo").collect()
    for r in got:
        own = [x[1:] for x in rows if x[0] == r.k]
        assert math.isclose(r.distance_km, max(metres(a, b) for a in own for b in own) / 1000, rel_tol=1e-9)


def test_tails_up_to_large_counts():
    for n in (1e4, 1e6, 1e9, 1e12):
        # the median of a Poisson count lies a third above its mean
        at_mean = float(tails.poisson_upper(np.array([n]), np.array([n]))[0])
        assert math.isclose(at_mean, 0.5 + 1 / (3 * math.sqrt(2 * math.pi * n)), abs_tol=1e-4 / math.sqrt(n))
        for z in (-3.0, 1.0, 5.0):
            normal = 0.5 * math.erfc(z / math.sqrt(2))
            assert math.isclose(float(tails.poisson_upper(np.array([n + z * math.sqrt(n)]), np.array([n]))[0]), normal, rel_tol=60 / math.sqrt(n))
            k = 0.1 * n + z * math.sqrt(0.09 * n)
            assert math.isclose(float(tails.binomial_upper(np.array([k]), np.array([n]), 0.1)[0]), normal, rel_tol=60 / math.sqrt(0.1 * n))


def test_tails_agree_where_methods_meet():
    k, lam = np.array([2990.0, 3005.0, 3050.0]), np.array([3000.0, 3000.0, 3000.0])
    exact = [1 - math.fsum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(int(a))) for a, m in zip(k, lam)]
    assert np.allclose(tails.poisson_upper(k, lam), exact, rtol=1e-9)
    n = 60_000
    exact = [math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.1) + (n - i) * math.log(0.9)) for i in range(k, n + 1)) for k in (5900, 6001, 6200)]
    assert np.allclose(tails.binomial_upper(np.array([5900, 6001, 6200]), np.full(3, n), 0.1), exact, rtol=1e-8)
    assert tails.poisson_upper(np.array([0.0, 5.0]), np.array([1e9, 1e9])).tolist() == [1.0, 1.0]


def test_money_text_of_fractions_and_large_amounts(spark):
    cases = {1234.996: "1,235.00", 999.999: "1,000.00", 0.004: "0", 0.25: "0.25", 2e14 + 0.5: "20,00,00,00,00,00,000.50", -99_999.999: "-1,00,000.00"}
    df = spark.createDataFrame([(k,) for k in cases], "v double")
    assert {r.v: r.t for r in df.select("v", scalar.indian_grouping(F.col("v")).alias("t")).collect()} == cases
    amounts = {2e14: "Rs 20000000.0 Cr", 12_340_000.0: "Rs 1.23 Cr", 150_000.0: "Rs 1.5 L", 99_999.5: "Rs 99,999.50"}
    df = spark.createDataFrame([(k,) for k in amounts], "v double")
    assert {r.v: r.t for r in df.select("v", scalar.human_amount(F.col("v")).alias("t")).collect()} == amounts


def test_zero_shot_with_many_labels_and_ties(spark):
    rng = np.random.default_rng(3)
    labels = [(f"l{i:03d}", [float(x) for x in rng.standard_normal(6)]) for i in range(60)]
    labels += [("a_tie", labels[7][1])]
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(40)] + [(99, labels[7][1])]
    df, known = spark.createDataFrame(rows, "i int, v array<double>"), spark.createDataFrame(labels, "label string, vec array<double>")
    one, many = ({r.i: r for r in photos.zero_shot(df, "v", known, block=b).collect()} for b in (256, 7))
    m = np.array([v for _, v in labels])
    for i, v in rows:
        cos = m @ v / np.linalg.norm(m, axis=1) / np.linalg.norm(v)
        assert one[i].predicted == many[i].predicted and math.isclose(one[i].similarity, cos.max(), rel_tol=1e-12)
        assert math.isclose(one[i].confidence, np.exp(cos.max()) / np.exp(cos).sum(), rel_tol=1e-9) and math.isclose(one[i].confidence, many[i].confidence, rel_tol=1e-9)
    assert one[99].predicted == "a_tie"


def test_forward_window_with_repeated_rows(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randint(1, 20), rng.choice([1, 1, 2]), rng.randint(1, 9)) for _ in range(120)]
    rows += rows[:20] + [(None, 3, 1, 5), (None, 3, 1, 5)]
    df = spark.createDataFrame(rows, "k string, day int, tie int, amount long").withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(day)"))
    got = sorted((r.k or "", r.day, r.tie, r.amount, r.window_count, r.window_total, r.window_marked)
                 for r in sequences.forward_window(df, ["k"], "ts", "tie", "amount", 3, F.col("amount") > 5).collect())
    want = []
    for k, d, t, a in rows:
        inside = [x for kk, dd, tt, x in rows if kk == k and ((dd == d and tt >= t) or d < dd <= d + 3)]
        want.append((k or "", d, t, a, len(inside), sum(inside), sum(x > 5 for x in inside)))
    assert got == sorted(want)
