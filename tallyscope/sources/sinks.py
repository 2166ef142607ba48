"""Writers: keyed merge, keyed table of buckets, partitioned append, GeoJSON export, run statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation
from pyspark.sql.types import LongType, StructField, StructType


def merge(current: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Current rows with ``update`` columns taken from incoming ones, plus new rows.

    Full outer join on the keys; other columns of known rows stay as they were.
    """
    keys = list(keys)
    new = incoming.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_new"), F.lit(True).alias("_in"))
    old = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_old"), F.lit(True).alias("_have"))
    both = old.join(new, keys, "full")
    cols = []
    for c in current.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in update:
            cols.append(F.when(F.col("_in"), F.col("_new")[c]).otherwise(F.col("_old")[c]).alias(c))
        else:
            cols.append(F.when(F.col("_have"), F.col("_old")[c]).otherwise(F.col("_new")[c]).alias(c))
    return both.select(*cols)


def latest(incoming: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One incoming row per key, the last by ``order``, so that a merge is unambiguous."""
    rest = [c for c in incoming.columns if c not in keys]
    return incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def append_findings(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Append to a findings table; rows of a partition value are gathered before writing."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


@dataclass(frozen=True)
class KeyedTable:
    """A table in buckets of its keys, changed by whole buckets under numbered versions.

    ``data/version=v/bucket=b`` holds what version ``v`` made of bucket ``b``;
    ``manifest/version=v`` is one file that names the version of every bucket. It
    appears as a whole, after the data, and commits the version: readers see the last
    one, and what a stopped writer left behind is overwritten when it runs again.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: StructType
    buckets: int = 64

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)))

    def _put(self, dealt: DataFrame, version: int, held: dict[int, int]) -> None:
        dealt.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        written = self.spark.read.schema(StructType([*self.schema, StructField("bucket", LongType())])).parquet(f"{self.path}/data/version={version}")
        held = {**held, **{r["bucket"]: version for r in written.select("bucket").distinct().collect()}}  # at most one a bucket
        rows = self.spark.createDataFrame([*held.items(), (None, version)], "bucket long, holds long")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={version}")

    def create(self, df: DataFrame) -> None:
        """Version 0."""
        self._put(self._dealt(df.select(*self.schema.names)), 0, {})

    def manifest(self) -> tuple[int, dict[int, int]]:
        """The last version, and the version that holds each bucket with rows."""
        listed = self.spark.read.schema("bucket long, holds long, version long").json(f"{self.path}/manifest")
        last = listed.agg(F.max("version")).first()[0]
        rows = listed.filter(F.col("version") == last).filter("bucket IS NOT NULL").collect()  # at most one a bucket
        return last, {r["bucket"]: r["holds"] for r in rows}

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The last version, or some of its buckets."""
        _, held = self.manifest()
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, incoming: DataFrame, update: Sequence[str], order: Sequence[str], version: int) -> None:
        """Merge rows (the last by ``order`` of each key) as ``version``; only their buckets are read and rewritten.

        A version that is not above the last one was committed before: nothing happens.
        """
        last, held = self.manifest()
        if version <= last:
            return
        new = self._dealt(latest(incoming, self.keys, *order)).persist()
        try:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]
            self._put(self._dealt(merge(self.read(touched), new, self.keys, update)), version, held)
        finally:
            new.unpersist()


def geojson_features(df: DataFrame, properties: Sequence[str], geometry: Column) -> DataFrame:
    """One GeoJSON feature per row as text, ready for ``write.text``."""
    return df.select(
        F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value")
    )


def multi_polygon(polygons: Column) -> Column:
    return F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """The same rows with counters that fill in when the write runs."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]), watch
