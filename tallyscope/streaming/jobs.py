"""Structured Streaming versions of the time-clustered detectors.

The batch operators define the results; late rows beyond the watermark are dropped.
No job keeps state for ever: what lives longer than a window is a table of landed rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import KeyedTable


def upload_bursts(stream: DataFrame, work: str, ts: str, gap: str = "300 seconds", late: str = "1 hour", at_least: int = 5) -> DataFrame:
    """Upload sessions per work, emitted once the watermark passes them."""
    return (
        stream.withWatermark(ts, late).groupBy(work, F.session_window(ts, gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("photos"), F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"))
        .filter(F.col("photos") >= at_least).drop("s")
    )


def rapid_transfers(stream: DataFrame, fto: str, account: str, ts: str, amount: str, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """What is known of an order from the payments of one window of the span.

    A row is emitted when the watermark has passed the window, and its state goes: state
    is one row for each order paid in the windows still open. Rows of an order add up
    (``folded_transfers``), in any order and number, so a payment that comes in a later
    window corrects the verdict without the stream having kept the order.
    """
    rows = stream.withWatermark(ts, late).select(F.col(fto).cast("string").alias(fto), F.col(account).cast("string").alias(account), ts, F.col(amount).cast("double").alias(amount))
    return rows.groupBy(fto, F.window(ts, f"{hours} hours")).agg(
        F.count(F.lit(1)).alias("payments"), F.min(ts).alias("first_paid"), F.max(ts).alias("last_paid"), F.sum(amount).alias("total_amount"),
        F.min(account).alias("least_account"), F.max(account).alias("greatest_account"),
    ).drop("window")


def folded_transfers(parts: DataFrame, fto: str) -> DataFrame:
    """The rows of ``rapid_transfers`` with one row per order; the registry is compacted by writing this."""
    return parts.groupBy(fto).agg(
        F.sum("payments").alias("payments"), F.min("first_paid").alias("first_paid"), F.max("last_paid").alias("last_paid"), F.sum("total_amount").alias("total_amount"),
        F.min("least_account").alias("least_account"), F.max("greatest_account").alias("greatest_account"),
    )


def rapid_verdicts(parts: DataFrame, fto: str, hours: int = 24) -> DataFrame:
    """Orders by what was told of them so far: ``rapid`` if two or more accounts were paid within the span."""
    span = (F.unix_micros("last_paid") - F.unix_micros("first_paid")) / 3_600_000_000
    several = F.coalesce(F.col("least_account") != F.col("greatest_account"), F.lit(False))
    return folded_transfers(parts, fto).select(fto, "payments", several.alias("several"), span.alias("span_hours"), "total_amount", (several & (span <= hours)).alias("rapid"))


def hash_sightings(stream: DataFrame, hash_col: str, work: str, ts: str, life: str = "30 days", late: str = "1 hour") -> DataFrame:
    """The least and greatest work that used a hash in one window of its life.

    Counted before the shuffle, so a hash of many photos is one row a task. State goes
    when the watermark has passed the window; ``reused_hashes`` joins the windows.
    """
    rows = stream.withWatermark(ts, late).filter(F.col(hash_col).isNotNull()).select(F.col(hash_col).cast("string").alias(hash_col), F.col(work).cast("string").alias(work), ts)
    return rows.groupBy(hash_col, F.window(ts, life)).agg(F.min(work).alias("first_work"), F.max(work).alias("other_work"), F.min(ts).alias("first_seen")).drop("window")


def reused_hashes(sightings: DataFrame, hash_col: str) -> DataFrame:
    """Hashes seen in two or more works, with the least and the greatest of them, however far apart in time."""
    folded = sightings.groupBy(hash_col).agg(F.min("first_work").alias("first_work"), F.max("other_work").alias("other_work"), F.min("first_seen").alias("first_seen"))
    return folded.filter(F.col("first_work") != F.col("other_work"))


def split_candidates(stream: DataFrame, account: str, ts: str, amount: str, threshold: float = 50_000, days: int = 7, late: str = "1 day") -> DataFrame:
    """Accounts with three or more small payments above twice the threshold in a sliding window.

    A screen: its windows cover every case of the exact batch rule and some more.
    """
    return (
        stream.filter(F.col(amount) < threshold).withWatermark(ts, late)
        .groupBy(account, F.window(ts, f"{days + 2} days", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("payments"), F.sum(amount).alias("total"))
        .filter((F.col("payments") >= 3) & (F.col("total") > 2 * threshold))
        .select(account, F.col("w.start").alias("window_start"), "payments", "total")
    )


def small_payments(stream: DataFrame, account: str, ts: str, amount: str, threshold: float = 50_000, late: str = "1 day") -> DataFrame:
    """The small payments of an account and day, from which ``split_windows`` tells what ``split_candidates`` would.

    A payment is one state, not one for each of the windows that it lies in.
    """
    return (
        stream.filter(F.col(amount) < threshold).withWatermark(ts, late).groupBy(account, F.window(ts, "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("payments"), F.sum(amount).alias("total"))
        .select(account, F.to_date("w.start").alias("day"), "payments", "total")
    )


def split_windows(parts: DataFrame, account: str, threshold: float = 50_000, days: int = 7) -> DataFrame:
    """The windows of ``split_candidates`` from the rows of ``small_payments``.

    A day goes to its windows only where all that its windows reach would do for one.
    """
    def enough(payments: Column, total: Column) -> Column:
        return (payments >= 3) & (total > 2 * threshold)

    span = days + 2
    daily = parts.groupBy(account, "day").agg(F.sum("payments").alias("payments"), F.sum("total").alias("total"))
    # one row a day
    reach = W.partitionBy(account).orderBy(F.unix_date("day")).rangeBetween(1 - span, span - 1)
    near = daily.withColumns({"_n": F.sum("payments").over(reach), "_t": F.sum("total").over(reach)}).filter(enough(F.col("_n"), F.col("_t")))
    starts = near.withColumn("window_start", F.explode(F.sequence(F.date_sub("day", span - 1), F.col("day"))))
    return starts.groupBy(account, "window_start").agg(F.sum("payments").alias("payments"), F.sum("total").alias("total")).filter(enough(F.col("payments"), F.col("total")))


def daily_counts(stream: DataFrame, ts: str, kind: str, late: str = "1 hour") -> DataFrame:
    """Rows per kind and day in append mode."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("count"))
        .select(F.to_date("w.start").alias("day"), kind, "count")
    )


def drain(stream: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], folder: str, closing: dict[str, object] | None = None) -> DataFrame:
    """Everything that ``build(stream)`` emits until the landed input ends, open groups included.

    The query runs to the end of the input. Then one closing row of a far time lands
    in a folder that the query also reads, and it runs on from its checkpoint: the
    watermark passes all groups, which are emitted. The closing row has ``closing``
    and is null elsewhere; its own group stays open.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/end")
    ends = spark.readStream.schema(stream.schema).parquet(f"{folder}/end")
    out = build(stream.unionByName(ends))
    for last in (False, True):
        if last:
            values = {**(closing or {}), ts: "2200-01-01"}
            row = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema])
            row.write.mode("append").parquet(f"{folder}/end")
        run = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def merge_stream(stream: DataFrame, table: KeyedTable, update: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch into a keyed table as the version after its number.

    The numbers go on from ``checkpoint`` after a restart; a batch that was committed
    before the stop is run again by Spark and changes nothing.
    """
    def apply(batch: DataFrame, number: int) -> None:
        table.merge(batch, update, order, number + 1)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
