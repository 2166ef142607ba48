"""Amounts halfway between two texts."""

import duckdb
from pyspark.sql import functions as F

from tallyscope.functions import scalar


def test_amounts_halfway_between_two_texts(spark):
    halves = spark.range(2000).select(((F.col("id") * 2 + 1) * 50_000.0).alias("w")).filter("w >= 10000000")
    pdf = halves.toPandas()  # noqa: F841 - read by duckdb
    want = duckdb.sql("SELECT w, 'Rs ' || regexp_replace(CAST(CAST(round(w / 10000000, 2) AS DECIMAL(30,2)) AS VARCHAR), '0$', '') || ' Cr' FROM pdf").fetchall()
    got = halves.select("w", scalar.human_amount(F.col("w"))).collect()
    assert sorted(map(tuple, got)) == sorted(want)
