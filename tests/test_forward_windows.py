"""Forward windows of keys with few rows and with many."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import sequences

FIRST = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("few", [0, 12, 1000])
def test_windows_from_either_side(spark, few):
    rng = random.Random(few)
    rows = []
    for key, n in ((1, 5), (2, 40), (None, 12), (3, 13), (4, 1)):
        for _ in range(n):
            at = FIRST + datetime.timedelta(hours=rng.randrange(0, 400, 8))
            rows.append((key, at, rng.randrange(4), rng.choice([Decimal(rng.randrange(900)) / 100, Decimal(2)])))
    df = spark.createDataFrame([*rows, (1, None, 1, Decimal(1))], "k int, ts timestamp, tie int, amount decimal(14,2)").repartition(3)
    out = sequences.forward_window(df, ["k"], "ts", "tie", "amount", 3, F.col("amount") > 5, few=few)
    got = sorted(((r["k"] or 0, r["ts"], r["tie"], r["amount"], r["window_count"], r["window_total"], r["window_marked"]) for r in out.collect()))
    want = []
    for k, at, tie, amount in rows:
        inside = [a for j, b, u, a in rows if j == k and (b > at or (b == at and u >= tie)) and b < at + datetime.timedelta(days=4)]
        want.append((k or 0, at, tie, amount, len(inside), sum(inside), sum(a > 5 for a in inside)))
    assert got == sorted(want)


def test_rows_of_small_keys_travel_once(spark):
    df = spark.range(200).select((F.col("id") % 50).alias("k"), F.timestamp_seconds(F.col("id") * 1000).alias("ts"), "id", F.lit(1.0).alias("amount"))
    plan = sequences.forward_window(df, ["k"], "ts", "id", "amount", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
