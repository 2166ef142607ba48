"""Ordered analytics that stay distributed under a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ordered import attach, scan, value_bucket
from ..session import durable


def backlog(df: DataFrame, keys: Sequence[str], period: str, added: str, removed: str) -> DataFrame:
    """Running backlog that never falls below zero.

    ``max(0, prev + added - removed)`` unrolls to the running sum minus its lowest
    value so far (at most zero). Input: one row per key and period.
    """
    w = W.partitionBy(*keys).orderBy(period).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        df.withColumn("_s", F.sum(F.col(added) - F.col(removed)).over(w))
        .withColumn("pending", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
        .drop("_s")
    )


def day_streaks(df: DataFrame, keys: Sequence[str], day: str, longer_than: int = 14) -> DataFrame:
    """Runs of consecutive days longer than a limit.

    Days are distinct per key, so a partition holds at most the days of the span.
    """
    days = df.select(*keys, F.col(day).cast("date").alias("_d")).distinct()
    w = W.partitionBy(*keys).orderBy("_d")
    island = F.date_sub(F.col("_d"), F.row_number().over(w))
    return (
        days.withColumn("_g", island).groupBy(*keys, "_g")
        .agg(F.min("_d").alias("streak_start"), F.max("_d").alias("streak_end"), F.count(F.lit(1)).alias("days"))
        .filter(F.col("days") > longer_than).drop("_g")
    )


def gap_sessions(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_seconds: int = 300, measure: str | None = None
) -> DataFrame:
    """Sessions of rows whose neighbours are at most ``gap_seconds`` apart.

    Rows are scanned by hour slices; a session is numbered by the running count of
    gaps, so a key with any number of rows is spread over its hours.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(tie), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), *([measure] if measure else []))
    base = base.withColumn("_h", F.floor(F.col("_us") / 3_600_000_000))
    order = [F.col("_us"), F.col(tie)]
    gaps = scan(base, keys, order, F.col("_h"), lags={"_prev": F.col("_us")})
    opens = F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = scan(gaps.withColumn("_new", opens), keys, order, F.col("_h"), sums={"session": F.col("_new")})
    aggs = [
        F.min("_us").alias("_a"), F.max("_us").alias("_b"), F.count(F.lit(1)).alias("rows"),
        *([F.sum(measure).alias("total")] if measure else []),
    ]
    out = numbered.groupBy(*keys, "session").agg(*aggs)
    span = (F.col("_b") - F.col("_a")) / 1e6
    return (
        out.withColumn("started_at", F.timestamp_micros("_a")).withColumn("ended_at", F.timestamp_micros("_b"))
        .withColumn("span_seconds", span)
        .withColumn("mean_gap_seconds", F.when(F.col("rows") > 1, span / (F.col("rows") - 1)))
        .drop("_a", "_b")
    )


def close_pairs(df: DataFrame, keys: Sequence[str], ts: str, tie: str, within_seconds: float = 60) -> DataFrame:
    """Neighbouring rows less than ``within_seconds`` apart."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    base = df.withColumn("_us", us).withColumn("_h", F.floor(F.col("_us") / 3_600_000_000))
    nxt = scan(
        base, keys, [F.col("_us"), F.col(tie)], F.col("_h"),
        leads={"_nus": F.col("_us"), "next_id": F.col(tie)},
    )
    gap = (F.col("_nus") - F.col("_us")) / 1e6
    return nxt.withColumn("gap_seconds", gap).filter(gap < within_seconds).drop("_us", "_h", "_nus")


def primary_per_group(df: DataFrame, keys: Sequence[str], score: str, *first: str) -> DataFrame:
    """The row with the highest score per key, the first one on ties.

    A ``max_by`` aggregate combines on the map side; no group is sorted.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct((-F.col(score)).alias("s"), *[F.col(c) for c in first])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The newest row per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def mode_per_group(df: DataFrame, keys: Sequence[str], value: str, *first_seen: str) -> DataFrame:
    """Most frequent value per key; on ties the one seen first."""
    seen = F.min(F.struct(*first_seen)) if first_seen else F.min(value)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), seen.alias("_seen"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col("_seen"))).alias(value), F.max("n").alias("n")
    )


def centred_mean(df: DataFrame, keys: Sequence[str], period: str, measure: str, reach: int) -> DataFrame:
    """Mean over ``reach`` periods on either side. Input: one row per key and period."""
    w = W.partitionBy(*keys).orderBy(period).rowsBetween(-reach, reach)
    return df.withColumn("moving_avg", F.avg(measure).over(w))


def rank_weighted_sum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum of rank times value in ascending order, from runs of equal values."""
    keys = list(keys)
    runs = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = scan(runs, keys, [F.col("_v")], value_bucket(F.col("_v")), sums={"_cum": F.col("_n")})
    n, cum = F.col("_n").cast("double"), F.col("_cum").cast("double")
    return ranked.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum(n * F.col("_v")).alias("total"),
        F.sum(n * (2 * cum - n + 1) / 2 * F.col("_v")).alias("rank_weighted"),
    )


def apportion(df: DataFrame, keys: Sequence[str], weight: str, tie: str, total: Column) -> DataFrame:
    """Largest-remainder split of a total by weight.

    Units per key are few (areas or categories); the extra ones go to the largest
    fractions, earlier units first on ties.
    """
    whole = W.partitionBy(*keys)
    raw = total * F.col(weight) / F.sum(weight).over(whole)
    by_fraction = whole.orderBy(F.col("_frac").desc(), F.col(tie))
    return (
        df.withColumn("_raw", raw)
        .withColumn("_base", F.floor("_raw"))
        .withColumn("_frac", F.col("_raw") - F.col("_base"))
        .withColumn("_left", total - F.sum("_base").over(whole))
        .withColumn("_pos", F.row_number().over(by_fraction))
        .withColumn("allotted", (F.col("_base") + F.when(F.col("_pos") <= F.col("_left"), 1).otherwise(0)).cast("long"))
        .drop("_raw", "_base", "_frac", "_left", "_pos")
    )


def period_change(df: DataFrame, keys: Sequence[str], period: str, measure: str, flat_pct: float = 0.0) -> DataFrame:
    """Difference, percentage and direction against the previous period.

    Input: one row per key and period.
    """
    w = W.partitionBy(*keys).orderBy(period)
    prev, cur = F.col("previous"), F.col(measure)
    pct = F.when(prev != 0, (cur - prev) / prev * 100).otherwise(0.0)
    return (
        df.withColumn("previous", F.lag(measure).over(w)).filter(prev.isNotNull())
        .withColumn("change", cur - prev).withColumn("change_pct", pct)
        .withColumn(
            "trend",
            F.when(F.col("change_pct") > flat_pct, "increasing")
            .when(F.col("change_pct") < -flat_pct, "decreasing").otherwise("stable"),
        )
    )


#: Rows of a key up to which its windows are summed outright.
_FEW = 1_000


def forward_window(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, amount: str, days: int = 7, mark: Column | None = None, few: int = _FEW
) -> DataFrame:
    """For each row: count and total from it to ``days`` whole days later.

    ``mark`` adds ``window_marked``, the number of marked rows in the window.

    A later row counts when the whole days between are at most ``days``; rows of
    the same instant count only when their tie-break is not smaller. Keys of at most
    ``few`` rows go through one window each, so that rows travel once. For other keys
    running totals answer the window (``_forward_totals``). Rows without ``ts`` are left out.
    """
    keys, df = list(keys), df.filter(F.col(ts).isNotNull())
    crowded = durable(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > few))
    if crowded.isEmpty():
        return _forward_ranges(df, keys, ts, tie, amount, days, mark)
    sized = attach(df, crowded, keys)
    small, large = (sized.filter(c).drop("_size") for c in ("_size IS NULL", "_size IS NOT NULL"))
    return _forward_ranges(small, keys, ts, tie, amount, days, mark).unionByName(_forward_totals(large, keys, ts, tie, amount, days, mark))


def _forward_ranges(df: DataFrame, keys: list[str], ts: str, tie: str, amount: str, days: int, mark: Column | None) -> DataFrame:
    """Every row's window is what lies from its instant on, less what is of the same instant with a smaller tie-break."""
    reach = (days + 1) * 86_400_000_000
    marked = F.when(mark if mark is not None else F.lit(False), 1).otherwise(0)
    base = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_mark", marked)
    ahead = W.partitionBy(*keys).orderBy("_us").rangeBetween(0, reach - 1)
    upto = W.partitionBy(*keys, "_us").orderBy(tie).rangeBetween(W.unboundedPreceding, W.currentRow)
    equal = W.partitionBy(*keys, "_us", tie)
    out = {}
    for name, sums in (("window_count", F.count(F.lit(1))), ("window_total", F.sum(amount)), ("window_marked", F.sum("_mark"))):
        smaller = F.coalesce(sums.over(upto), F.lit(0)) - F.coalesce(sums.over(equal), F.lit(0))
        out[name] = sums.over(ahead) - smaller
    return base.withColumns(out).drop("_us", "_mark")


def _forward_totals(df: DataFrame, keys: list[str], ts: str, tie: str, amount: str, days: int, mark: Column | None) -> DataFrame:
    """What lies before the row and what lies at or before the last row of its window, from one scan.

    The scan goes in day slices, and the end of the window is found in the slice where it
    falls, so a hot key stays spread out.
    """
    reach = (days + 1) * 86_400_000_000
    base = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    # rows of one instant and tie-break count each other: they are one place with a weight
    marked = F.when(mark if mark is not None else F.lit(False), 1).otherwise(0)
    places = base.groupBy(*keys, tie, "_us").agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_sum"), F.sum(marked).alias("_marks"))
    cut = places.withColumn("_kind", F.lit(1)).withColumn("_at", F.col("_us"))
    # an end marker per place sits just before the first instant outside the window
    ends = places.withColumn("_kind", F.lit(0)).withColumn("_at", F.col("_us") + reach)
    both = cut.unionByName(ends).withColumn("_day", F.floor(F.col("_at") / 86_400_000_000))
    real = F.col("_kind") == 1
    run = scan(
        both, keys, [F.col("_at"), F.col("_kind"), F.col(tie)], F.col("_day"),
        sums={
            "_c": F.when(real, F.col("_n")).otherwise(0),
            "_t": F.when(real, F.col("_sum")).otherwise(F.lit(0).cast("decimal(1,0)")),
            "_m": F.when(real, F.col("_marks")).otherwise(0),
        },
    )
    # the two sums of a place meet in one aggregate
    window = run.groupBy(*keys, tie, "_us").agg(
        F.sum(F.when(real, -F.col("_c") + F.col("_n")).otherwise(F.col("_c"))).alias("window_count"),
        F.sum(F.when(real, -F.col("_t") + F.col("_sum")).otherwise(F.col("_t"))).alias("window_total"),
        F.sum(F.when(real, -F.col("_m") + F.col("_marks")).otherwise(F.col("_m"))).alias("window_marked"),
    )
    return attach(base, window, [*keys, tie, "_us"], "inner").drop("_us")
