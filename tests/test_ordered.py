"""Scans of a key whose rows crowd into one bucket or one instant."""

import random

import pytest
from pyspark.sql import functions as F

from tallyscope import ordered

MOST = 500


@pytest.fixture(scope="module")
def crowd(spark):
    """90 % of the rows in one hour of one key, half of those at one instant; ids break ties."""
    rng = random.Random(4)
    rows = [("a", 7 * 3600 + (1800 if i % 2 else rng.randrange(3600)), i, rng.randint(-5, 9)) for i in range(9000)]
    rows += [(rng.choice("abc"), rng.randrange(86_400), i, rng.randint(-5, 9)) for i in range(9000, 10_000)]
    rows += [(None, 5, 10_000 + i, 1) for i in range(1300)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, s long, id long, x int").repartition(5)


def test_no_part_is_crowded(crowd):
    rows, df = crowd
    cut = ordered.split(df.withColumn("_bucket", F.floor(F.col("s") / 3600)), ["k"], [F.col("s"), F.col("id")], MOST)
    sizes = cut.groupBy("k", "_bucket", "_part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("s", "id")).alias("a"), F.max(F.struct("s", "id")).alias("b")).collect()
    assert sum(r["n"] for r in sizes) == len(rows)
    hot = sorted((r["_part"], r["n"], r["a"], r["b"]) for r in sizes if r["k"] == "a" and r["_bucket"] == 7)
    assert len(hot) > 9 and max(r["n"] for r in sizes) < 2 * sum(n for _, n, _, _ in hot) / len(hot)
    assert all(x[3] < y[2] for x, y in zip(hot, hot[1:]))


@pytest.mark.parametrize("most", [MOST, ordered.MOST])
def test_scan_of_a_crowded_key(crowd, most):
    rows, df = crowd
    out = ordered.scan(
        df, ["k"], [F.col("s"), F.col("id")], F.floor(F.col("s") / 3600), sums={"sum": F.col("x")}, lags={"before": F.col("id")}, leads={"after": F.col("id")},
        row_number="n", most=most,
    )
    want, last = {}, None
    for k, s, i, x in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        n, total = (want[last[1]][0] + 1, want[last[1]][1] + x) if last and last[0] == k else (1, x)
        if n > 1:
            want[last[1]][3] = i
        want[i] = [n, total, last[1] if n > 1 else None, None]
        last = (k, i)
    assert {r["id"]: [r["n"], r["sum"], r["before"], r["after"]] for r in out.collect()} == want


def test_many_borders(spark):
    df = spark.range(40_000).select(F.lit(1).alias("_bucket"), (F.col("id") * 7919 % 40_000).alias("v"))
    cut = ordered.split(df, [], [F.col("v")], 100)
    parts = cut.groupBy("_part").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    assert len(parts) > 200 and all(x["b"] < y["a"] for x, y in zip(parts, parts[1:])) and max(r["n"] for r in parts) < 250
