"""Works beside the mean of a crowded kind."""

import pytest
from pyspark.sql import functions as F

from tallyscope.plans import reports


def test_works_of_a_crowded_kind_stay_apart(spark):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # less than the works take
    try:
        check_crowded_kind(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def check_crowded_kind(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 100 == 0, F.lit("b")).otherwise("a").alias("kind"), (F.col("id") % 7 + 1.0).alias("spent"), F.lit(2.0).alias("progress"))
    df = df.unionByName(df.limit(1).withColumn("kind", F.lit(None).cast("string")))
    got = reports.against_peers(df, "kind", "spent", "progress")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    rows = got.collect()
    assert len(rows) == 3000
    for kind in "ab":
        of = [r for r in rows if r["kind"] == kind]
        mean = sum(r["spent"] / 2 for r in of) / len(of)
        assert all(r["relative"] == pytest.approx(r["spent"] / 2 / mean) for r in of)
