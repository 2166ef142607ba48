"""Composite risk, the daily scan and the summaries drawn from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import tier
from ..operators.joins import relevant_steps
from ..operators.stats import benford_deviation, mean_of_available
from ..ordered import attach

# Weight of each dimension in the composite score.
WEIGHTS = {
    "expenditure_score": 0.25, "attendance_score": 0.25, "satellite_score": 0.20, "photo_score": 0.15, "payment_score": 0.15,
}
FLAG_NAMES = {
    "expenditure_score": "expenditure_anomaly", "attendance_score": "attendance_anomaly", "satellite_score": "satellite_mismatch",
    "photo_score": "photo_anomaly", "payment_score": "payment_anomaly",
}


# Kinds of anomaly that start each analysis.
TRIGGERS = {
    "satellite_verification": ("satellite_mismatch", "expenditure_anomaly"),
    "muster_roll_forensics": ("attendance_anomaly", "ghost_worker", "muster_roll_fraud"),
    "payment_analysis": ("payment_anomaly", "material_ratio_violation", "expenditure_anomaly"),
    "photo_verification": ("photo_anomaly",),
}


def investigations(scored: DataFrame, key: str) -> DataFrame:
    """Analyses to run for every unit, from its flags; all of them without flags."""
    return relevant_steps(scored, [key], "anomaly_flags", TRIGGERS)


def attendance_score(df: DataFrame, keys: Sequence[str], *, days: str, verified: str, category: str, day: str, earthwork: str = "earthwork") -> DataFrame:
    """Mean of first-digit deviation, biometric gap and heavy monsoon earthwork share."""
    keys = list(keys)
    dig = benford_deviation(df.filter(F.col(days) > 0), keys, days).select(*keys, F.col("deviation").alias("_b"))
    heavy = F.month(day).between(6, 9) & (F.col(category) == earthwork) & (F.col(days) > 50)
    agg = df.groupBy(*keys).agg(
        F.sum(days).alias("_t"), F.sum(verified).alias("_v"), (F.count_if(heavy) / F.count(F.lit(1))).alias("_m")
    )
    gap = F.when(F.col("_t") > 0, F.least((1 - F.col("_v") / F.when(F.col("_t") > 0, F.col("_t"))) * 1.5, F.lit(1.0)))
    monsoon = F.least(F.col("_m") * 5, F.lit(1.0))
    return attach(agg, dig, keys).select(*keys, mean_of_available([F.col("_b"), gap, monsoon]).alias("attendance_score"))


def composite(units: DataFrame, key: str, scores: Sequence[DataFrame], weights: Mapping[str, float] = WEIGHTS, flag_at: float = 0.60) -> DataFrame:
    """All units with their five scores (0 when absent), composite and flags."""
    out = units
    for s in scores:
        out = out.join(s, key, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in out.columns else F.lit(0.0) for c in weights})
    total: Column = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.col(c)
    flags = F.array_compact(F.array(*[F.when(F.col(c) >= flag_at, FLAG_NAMES.get(c, c)) for c in weights]))
    return out.withColumn("composite_score", total).withColumn("anomaly_flags", flags)


def roll_up_max(scored: DataFrame, level: str) -> DataFrame:
    return scored.groupBy(level).agg(F.max("composite_score").alias("risk_score"))


def priority_queue(scored: DataFrame, key: str, at_least: float = 0.70, limit: int | None = None) -> DataFrame:
    """Units to investigate, riskiest first."""
    out = scored.filter(F.col("composite_score") >= at_least).orderBy(F.col("composite_score").desc(), key)
    return out if limit is None else out.limit(limit)


def dashboard(scored: DataFrame, *, district: str, block: str, state: str, queue_at: float = 0.70) -> DataFrame:
    """One row: units, queue length, district tiers, coverage and leakage in crore."""
    tiers = roll_up_max(scored, district).select(tier(F.col("risk_score")).alias("t")).agg(
        *[F.count_if(F.col("t") == t).alias(f"{t}_risk_districts") for t in ("high", "medium", "low")]
    )
    leak = F.sum(F.when(F.col("composite_score") >= 0.5, 50.0 * F.col("composite_score") * 0.3).otherwise(0.0)) / 100
    main = scored.agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("composite_score") >= queue_at).alias("queued"),
        F.count_distinct(block).alias("blocks"), F.count_distinct(state).alias("states"), leak.alias("leakage_crore"),
    )
    return main.withColumn("_k", F.lit(0)).join(tiers.withColumn("_k", F.lit(0)), "_k").drop("_k")


def flag_counts(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("anomaly_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("count"))


def district_scan(scored: DataFrame, payments: DataFrame, district: str, key: str, at_least: float = 0.70, top: int = 10) -> DataFrame:
    """Riskiest flagged units of every district with its payment totals.

    The window ranks the flagged units of a district only, a short list by design.
    """
    w = W.partitionBy(district).orderBy(F.col("composite_score").desc(), key)
    flagged = scored.filter(F.col("composite_score") >= at_least).withColumn("rank", F.row_number().over(w))
    return flagged.filter(F.col("rank") <= top).join(payments, district, "left")


def pilot_recommendation(df: DataFrame, *, ghosts: str, amount: str, mismatches: str, findings: str) -> DataFrame:
    high = (F.col(ghosts) > 10) | (F.col(amount) > 1_000_000) | (F.col(mismatches) > 2)
    moderate = (F.col(findings) > 5) | (F.col(amount) > 500_000)
    return df.withColumn("recommendation", F.when(high, "HIGH RISK").when(moderate, "MODERATE RISK").otherwise("LOW RISK"))
