"""Session settings and the durable lineage cut used by iterative jobs."""

from __future__ import annotations

import math
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Python workers receive this package's functions by value, so that executors
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

# Set only where the cluster has not chosen a value itself.
_SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when that costs one more exchange above the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build(app: str = "tallyscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's SQL defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SQL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL defaults to a session made elsewhere."""
    for key, value in _SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """``df`` dealt by ``keys`` over so many tasks that one holds about ``rows``; a table that needs no more tasks than a shuffle has is left to Spark.

    The memory of a task then stays the same as tables grow, as long as no key holds many rows.
    """
    tasks = math.ceil(df.count() / rows)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
        folder = tempfile.mkdtemp(prefix="tallyscope-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from there.

    Used between rounds of an iterative job: the plan stays short, a lost executor
    costs one re-read instead of a replay of all earlier rounds, and the columnar
    files can be pruned. The folder is the cluster's ``spark.checkpoint.dir``; its
    files may be removed once the results are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
