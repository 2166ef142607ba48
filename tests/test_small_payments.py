"""Split payments from the sums of days: the windows of the screen, and one state a day."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyscope.streaming import jobs


def test_windows_from_days_equal_sliding_windows(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(6), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 200)), rng.choice([20_000.0, 45_000.0, 60_000.0])) for _ in range(500)]
    rows += [(9, dt.datetime(2024, 3, d), 34_000.0) for d in (1, 5, 9)] + [(8, dt.datetime(2024, 3, d), 34_000.0) for d in (1, 5, 10)]
    df = spark.createDataFrame(rows, "account long, ts timestamp, amount double")
    want = {(r["account"], r["start"], r["payments"], r["total"]) for r in jobs.split_candidates(df, "account", "ts", "amount").withColumn("start", F.to_date("window_start")).collect()}
    days = jobs.small_payments(df, "account", "ts", "amount")
    assert days.count() == len({(a, t.date()) for a, t, x in rows if x < 50_000})
    assert {tuple(r) for r in jobs.split_windows(days, "account").collect()} == want
    assert (9, dt.date(2024, 3, 1), 3, 102_000.0) in want and not any(w[0] == 8 for w in want)
