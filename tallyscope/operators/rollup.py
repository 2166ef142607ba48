"""Aggregations: hierarchical roll-ups, breakdowns, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import risk_band


def weighted_risk(risk: str, weight: str, active: Column) -> Column:
    """Weighted mean over active rows; divides by one when all weights are zero."""
    w = F.sum(F.when(active, F.col(weight)))
    return F.coalesce(F.sum(F.when(active, F.col(risk) * F.col(weight))), F.lit(0.0)) / F.when(w == 0, 1.0).otherwise(
        F.coalesce(w, F.lit(1.0))
    )


def area_rollup(
    df: DataFrame,
    levels: Sequence[str],
    sums: Sequence[str],
    *,
    risk: str,
    weight: str,
    active: str,
    done: str,
    total: str,
) -> DataFrame:
    """Sums, weighted risk and completion for every prefix of ``levels``.

    ``rollup`` gives all levels in one pass; ``level`` counts the grouped columns.
    """
    out = df.rollup(*levels).agg(
        *[F.sum(c).alias(c) for c in sums],
        weighted_risk(risk, weight, F.col(active)).alias("risk_score"),
        F.count_if(F.col(active)).alias("active_units"),
        F.count(F.lit(1)).alias("units"),
        F.grouping_id().alias("_g"),
    )
    ones = F.bit_count("_g")
    return (
        out.withColumn("risk_band", risk_band(F.col("risk_score")))
        .withColumn("completion_rate_pct", F.col(done) / F.greatest(F.col(total), F.lit(1)) * 100)
        .withColumn("level", (F.lit(len(levels)) - ones).cast("int"))
        .drop("_g")
    )


def map_sums(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Sum a ``map<string, number>`` column key by key; the key set is a code list."""
    return (
        df.select(*keys, F.explode(column).alias("_k", "_v"))
        .groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
        .groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(column))
    )


def share_out(df: DataFrame, kind: str, amount: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Count per kind, and the group's total amount split by share of the count."""
    per = df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("count"), F.sum(amount).alias("_amount"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return per.withColumn(
        "estimated_amount", F.sum("_amount").over(whole) * F.col("count") / F.greatest(F.sum("count").over(whole), F.lit(1))
    ).drop("_amount")


def breakdowns(df: DataFrame, dims: Sequence[str], measure: str) -> DataFrame:
    """Counts by each dimension and overall, in one pass over grouping sets."""
    sets = [[d] for d in dims] + [[]]
    out = df.groupingSets(sets, *dims).agg(
        F.count(F.lit(1)).alias("count"), F.avg(measure).alias(f"mean_{measure}"), F.grouping_id().alias("_g")
    )
    name, value = F.lit("total"), F.lit("all")
    for i, d in enumerate(dims):
        here = F.col("_g").bitwiseAND(1 << (len(dims) - 1 - i)) == 0
        name, value = F.when(here, d).otherwise(name), F.when(here, F.col(d).cast("string")).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), "count", f"mean_{measure}")


def counted(df: DataFrame, keys: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Conditional counts per key."""
    return df.groupBy(*keys).agg(*[F.count_if(cond).alias(name) for name, cond in flags.items()])


def case_stats(
    cases: DataFrame, keys: Sequence[str], *, status: str, created: str, start: str, works: str, loss: str
) -> DataFrame:
    """Open and new cases, distinct works over all cases of a group, loss."""
    main = cases.groupBy(*keys).agg(
        F.count_if(F.col(status).isin("open", "under_investigation")).alias("open_cases"),
        F.count_if(F.col(created) >= start).alias("new_cases"),
        F.sum(loss).alias("total_suspicious_amount"),
    )
    ids = cases.select(*keys, F.explode(works).alias("_w")).groupBy(*keys).agg(F.count_distinct("_w").alias("flagged_works"))
    return main.join(ids, list(keys), "left").fillna(0, ["flagged_works"])


def weekly_stats(df: DataFrame, keys: Sequence[str], *, detected: str, updated: str, status: str, loss: str) -> DataFrame:
    """New, resolved and escalated records and the amount per week."""
    week = F.date_trunc("week", F.col(detected)).cast("date")
    after = F.col(updated) >= F.date_trunc("week", F.col(detected))
    return (
        df.withColumn("week", week)
        .groupBy(*keys, "week")
        .agg(
            F.count(F.lit(1)).alias("new_anomalies"),
            F.count_if((F.col(status) == "closed") & after).alias("resolved_cases"),
            F.count_if((F.col(status) == "escalated") & after).alias("escalated_cases"),
            F.sum(loss).alias("suspicious_amount"),
        )
    )


def top_kinds(df: DataFrame, keys: Sequence[str], kind: str, n: int = 10) -> DataFrame:
    """Most frequent kinds per key; ranks run over the few aggregated rows."""
    w = W.partitionBy(*keys).orderBy(F.col("count").desc(), F.col(kind))
    return (
        df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("count"))
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    )


def monthly_counts(df: DataFrame, keys: Sequence[str], day: str, as_of: str, months: int = 24) -> DataFrame:
    """Rows per month in the last ``months`` months before ``as_of``."""
    d = F.to_date(F.col(day))
    return (
        df.filter(d >= F.add_months(F.lit(as_of).cast("date"), -months))
        .groupBy(*keys, F.date_format(d, "yyyy-MM").alias("month"), F.month(d).alias("month_num"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def distinct_profile(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str], amount: str) -> DataFrame:
    """Distinct counts of several columns, total and number of rows per key.

    Spark counts by (key, column, value) first, then by key, so neither a hot key nor
    a long value list meets in one task; values keep their types.
    """
    return df.groupBy(*keys).agg(
        F.sum(amount).alias("total_amount"), F.count(F.lit(1)).alias("transactions"), *[F.count_distinct(col).alias(name) for name, col in distinct.items()])


def hierarchy(df: DataFrame, top: str, middle: str, leaf: str) -> DataFrame:
    """Nested top -> middle -> leaves from a flat administrative directory."""
    rows = df.select(top, middle, leaf).distinct()
    mids = rows.groupBy(top, middle).agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    return mids.groupBy(top).agg(F.array_sort(F.collect_list(F.struct(middle, "leaves"))).alias("middles"))


def facts_in_crore(df: DataFrame, lakhs: Sequence[str]) -> DataFrame:
    """Lakh columns of a metrics record restated in crore."""
    return df.withColumns({c.replace("_lakhs", "_crore"): F.col(c) / 100 for c in lakhs})
