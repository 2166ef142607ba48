"""Statistical detectors over all groups of a table at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as X
from ..functions.tails import binomial_tail, poisson_tail
from ..ordered import attach, quantiles
from .sequences import rank_weighted_sum

EXPECTED = {d: math.log10(1 + 1 / d) for d in range(1, 10)}


# -- first-digit tests ----------------------------------------------------

def digit_counts(df: DataFrame, keys: Sequence[str], digit: Column) -> DataFrame:
    """Columns ``d1``..``d9`` and ``n`` per key: one pass, one partial aggregate."""
    counts = [F.count_if(F.col("_d") == d).alias(f"d{d}") for d in range(1, 10)]
    return df.withColumn("_d", digit).groupBy(*keys).agg(*counts, F.count("_d").alias("n"))


def _sum(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _share(d: int) -> Column:
    return F.col(f"d{d}") / F.greatest(F.col("n"), F.lit(1))


def _chi_share() -> Column:
    return _sum([F.pow(_share(d) - p, 2) / p for d, p in EXPECTED.items()])


def benford_test(
    df: DataFrame, keys: Sequence[str], value: str, significance: float = 0.05, strict: bool = False
) -> DataFrame:
    """Chi-squared goodness of fit to the first-digit law, 8 degrees of freedom.

    The p-value is the closed form for an even number of degrees of freedom.
    """
    digit = X.first_digit_strict(F.col(value)) if strict else X.first_digit_text(F.col(value))
    half = F.col("chi2_statistic") / 2
    p = F.exp(-half) * (1 + half + F.pow(half, 2) / 2 + F.pow(half, 3) / 6)
    return (
        digit_counts(df, keys, digit)
        .withColumn("chi2_statistic", F.when(F.col("n") > 0, F.col("n") * _chi_share()).otherwise(0.0))
        .withColumn("p_value", p)
        .withColumn("is_anomalous", F.col("p_value") < significance)
        .withColumnRenamed("n", "n_values")
    )


def benford_digits(tested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form of a test result: one row per key and digit."""
    n = F.greatest(F.col("n_values"), F.lit(1))
    rows = F.array(*[
        F.struct(
            F.lit(d).alias("digit"), (F.col(f"d{d}") / n).alias("observed"), F.lit(p).alias("expected"),
            (F.col(f"d{d}") / n - p).alias("deviation"),
        )
        for d, p in EXPECTED.items()
    ])
    return tested.select(*keys, F.inline(rows))


def benford_score(df: DataFrame, keys: Sequence[str], value: str, flag_above: float = 0.15) -> DataFrame:
    """Composite distance from the first-digit law in [0, 1]; needs 20 digits."""
    devs = [F.abs(_share(d) - p) for d, p in EXPECTED.items()]
    score = (
        0.4 * F.least(_chi_share() / 20, F.lit(1.0))
        + 0.3 * F.least(_sum(devs) / 9 / 0.05, F.lit(1.0))
        + 0.3 * F.least(F.greatest(*devs) / 0.10, F.lit(1.0))
    )
    return (
        digit_counts(df, keys, X.first_digit_whole(F.col(value)))
        .select(*keys, "n", F.when(F.col("n") >= 20, score).otherwise(0.0).alias("score"))
        .withColumn("flagged", F.col("score") > flag_above)
    )


def benford_deviation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Summed relative squared deviation over 0.1, at most 1; needs 10 digits."""
    dev = F.least(_chi_share() / 0.1, F.lit(1.0))
    return digit_counts(df, keys, X.first_digit_whole(F.col(value))).select(
        *keys, "n", F.when(F.col("n") >= 10, dev).otherwise(0.0).alias("deviation")
    )


# -- round numbers and thresholds ------------------------------------------

def round_number_bias(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    suffixes: Sequence[int] = (500, 1000, 5000, 10000),
    expected: float = 0.10,
    significance: float = 0.05,
) -> DataFrame:
    """Share of amounts that are round multiples, with a one-sided binomial test."""
    whole = F.bround(F.col(value).cast("double"), 0).cast("long")
    bucket = F.lit(None).cast("int")
    for s in sorted(suffixes):
        bucket = F.when(whole % s == 0, s).otherwise(bucket)
    counts = [F.count_if(F.col("_b") == s).alias(f"suffix_{s}") for s in sorted(suffixes)]
    return (
        df.withColumn("_b", bucket)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total"), F.count("_b").alias("round_count"), *counts)
        .withColumn("round_pct", F.col("round_count") / F.greatest(F.col("total"), F.lit(1)))
        .withColumn("binom_p_value", binomial_tail(F.col("round_count"), F.col("total"), F.lit(float(expected))))
        .withColumn("is_anomalous", F.col("binom_p_value") < significance)
    )


def bunching(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    threshold: float,
    window: float = 0.05,
    significance: float = 0.05,
) -> DataFrame:
    """Excess of amounts just below a threshold, with a Poisson tail."""
    v, lower = F.col(value), threshold * (1 - window)
    exp = F.col("below_threshold") * window
    tail = F.when(
        (F.col("expected_count") > 0) & (F.col("bunching_count") > 0),
        poisson_tail(F.col("bunching_count").cast("double"), F.greatest("expected_count", F.lit(1e-12))),
    ).otherwise(1.0)
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_amounts"),
            F.count_if((v >= lower) & (v < threshold)).alias("bunching_count"),
            F.count_if(v < threshold).alias("below_threshold"),
        )
        .withColumn("expected_count", exp)
        .withColumn("ratio", F.col("bunching_count") / F.greatest(F.col("expected_count"), F.lit(1.0)))
        .withColumn("poisson_p_value", tail)
        .withColumn("is_anomalous", F.col("poisson_p_value") < significance)
    )


# -- outliers ---------------------------------------------------------------

def zscore_outliers(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 3.0) -> DataFrame:
    """Rows further than ``threshold`` sample deviations from their group mean.

    Mean and deviation are aggregated first and joined back, so that a hot group
    is never sorted or buffered in one task.
    """
    moments = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    moments = moments.filter(F.col("_sd") > 0)
    return (
        attach(df, moments, keys, "inner")
        .withColumn("z_score", (F.col(value) - F.col("_mean")) / F.col("_sd"))
        .filter(F.abs("z_score") > threshold)
        .drop("_mean", "_sd")
    )


def spikes(
    df: DataFrame, keys: Sequence[str], month: str, count: str, threshold: float = 2.5, min_months: int = 6
) -> DataFrame:
    """Months whose count is far above the mean of their group (population deviation)."""
    stats = df.groupBy(*keys).agg(
        F.avg(count).alias("mean_count"), F.stddev_pop(count).alias("_sd"), F.count(F.lit(1)).alias("_months")
    )
    year_end = F.month(F.col(month)).isin(2, 3)
    return (
        attach(df, stats.filter((F.col("_sd") > 0) & (F.col("_months") >= min_months)), keys, "inner")
        .withColumn("z_score", (F.col(count) - F.col("mean_count")) / F.col("_sd"))
        .filter(F.col("z_score") > threshold)
        .withColumn("is_year_end", year_end)
        .withColumn("severity", F.when(year_end, "high").otherwise("medium"))
        .withColumn("confidence", F.least(F.col("z_score") / 5, F.lit(1.0)))
        .drop("_sd", "_months")
    )


def mean_of_available(scores: Sequence[Column]) -> Column:
    """Mean of the scores that are not NULL; 0 when none is."""
    total = _sum([F.coalesce(s, F.lit(0.0)) for s in scores])
    n = _sum([s.isNotNull().cast("int") for s in scores])
    return F.when(n > 0, total / n).otherwise(0.0)


def expenditure_score(df: DataFrame, keys: Sequence[str], amount: str, day: str) -> DataFrame:
    """Outlier share, upper-fence share and year-end surge of spending per group."""
    keys = list(keys)
    v = F.col(amount).cast("double")
    base = df.withColumn("_v", v)
    march = F.month(F.col(day)) == 3
    stats = base.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_sd"),
        F.count_if(march).alias("_n3"), F.sum(F.when(march, F.col("_v"))).alias("_s3"),
        F.avg(F.when(~march, F.col("_v"))).alias("_rest"),
    )
    fences = attach(stats, quantiles(base, keys, "_v", {"_q1": 0.25, "_q3": 0.75}), keys)
    hits = (
        attach(base.select(*keys, "_v"), fences, keys, "inner")
        .groupBy(*keys)
        .agg(
            F.count_if((F.col("_sd") > 0) & (F.abs((F.col("_v") - F.col("_m")) / F.col("_sd")) > 2)).alias("_out"),
            F.count_if(F.col("_v") > F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))).alias("_above"),
        )
    )
    z = F.when((F.col("_n") > 2) & (F.col("_sd") > 0), F.least(F.col("_out") / F.col("_n") * 2, F.lit(1.0)))
    iqr = F.when(
        (F.col("_n") >= 4) & (F.col("_q3") > F.col("_q1")), F.least(F.col("_above") / F.col("_n") * 2.5, F.lit(1.0))
    )
    surge = F.when(
        (F.col("_n3") > 0) & (F.col("_rest") > 0), X.clip((F.col("_s3") / (F.col("_rest") * F.col("_n3")) - 2) / 3, 0.0, 1.0)
    )
    return attach(fences, hits, keys).select(
        *keys, z.alias("outlier_score"), iqr.alias("fence_score"), surge.alias("surge_score"),
        mean_of_available([z, iqr, surge]).alias("expenditure_score"),
    )


# -- inequality and seasonality ----------------------------------------------

def gini(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient of the non-negative values per group, clamped to [0, 1].

    Equal values are counted first; the rank sum of a run of equal values is
    closed form, so only distinct values are ordered, in value classes.
    """
    keys = list(keys)
    agg = rank_weighted_sum(df.filter(F.col(value) >= 0), keys, value)
    g = 2 * F.col("rank_weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")
    return agg.select(
        *keys, "n",
        F.when(F.col("total") > 0, X.clip(g, 0.0, 1.0)).otherwise(0.0).alias("gini"),
    )


def seasonal_decompose(
    df: DataFrame, series: Sequence[str], period: str, value: str, model: str = "additive", threshold: float = 2.0
) -> DataFrame:
    """Classical decomposition of one value per period and series.

    The input is one row per series and period (aggregate first), so a window
    partition holds at most the number of periods. The season length is
    ``min(12, n // 2)``, at least 2; series shorter than 4 are left out.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError(model)
    mult = model == "multiplicative"
    w = W.partitionBy(*series).orderBy(period)
    whole = W.partitionBy(*series)
    base = (
        df.filter(F.col(value).isNotNull())
        .withColumn("_i", F.row_number().over(w) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .filter(F.col("_n") >= 4)
        .withColumn("_p", F.greatest(F.lit(2), F.least(F.lit(12), F.floor(F.col("_n") / 2).cast("int"))))
    )
    v = F.col(value).cast("double")
    trend = F.lit(None).cast("double")
    for p in range(2, 13):
        h = p // 2
        # decimal values are summed exactly
        total = F.sum(value).over(w.rowsBetween(-h, h)).cast("double")
        if p % 2 == 0:
            total = total - 0.5 * (F.lag(value, h).over(w) + F.lead(value, h).over(w)).cast("double")
        trend = F.when(F.col("_p") == p, total / p).otherwise(trend)
    h = F.floor(F.col("_p") / 2)
    inside = (F.col("_i") >= h) & (F.col("_i") < F.col("_n") - h)
    # means add up in the order of the periods, so that reruns agree to the last bit
    all_rows = (W.unboundedPreceding, W.unboundedFollowing)
    phase = W.partitionBy(*series, "_phase").orderBy(period).rowsBetween(*all_rows)
    ordered = w.rowsBetween(*all_rows)
    # averaging over rows would weight phases unequally, so phases count once each
    once = F.when(F.col("_i") < F.col("_p"), F.col("_mean"))
    centre = F.avg(once).over(ordered)
    out = (
        base.withColumn("trend", F.when(inside, trend))
        .withColumn("_phase", F.col("_i") % F.col("_p"))
        .withColumn("_det", v / F.col("trend") if mult else v - F.col("trend"))
        .withColumn("_mean", F.avg("_det").over(phase))
        .withColumn("seasonal", F.col("_mean") / centre if mult else F.col("_mean") - centre)
        .withColumn(
            "residual",
            v / F.col("trend") / F.col("seasonal") if mult else v - F.col("trend") - F.col("seasonal"),
        )
        .withColumn("_rm", F.avg("residual").over(ordered))
        .withColumn("_rs", F.stddev_samp("residual").over(ordered))
    )
    flag = F.coalesce((F.col("_rs") > 0) & (F.abs(F.col("residual") - F.col("_rm")) > threshold * F.col("_rs")), F.lit(False))
    return out.withColumn("is_anomalous", flag).select(
        *series, period, value, F.col("_p").alias("season_length"), "trend", "seasonal", "residual", "is_anomalous"
    )


# -- audit --------------------------------------------------------------------

def statistical_audit(
    df: DataFrame, keys: Sequence[str], amount: str, unit: str, anomaly_rate: DataFrame | None = None
) -> DataFrame:
    """Points for each failed test and a level per group.

    ``unit`` is the column whose totals feed the inequality test (a panchayat);
    ``anomaly_rate`` has ``keys`` and ``anomaly_rate`` from a model, if any.
    """
    keys = list(keys)
    b = benford_test(df, keys, amount).select(*keys, F.col("is_anomalous").alias("benford"))
    r = round_number_bias(df, keys, amount).select(*keys, F.col("is_anomalous").alias("round_number"))
    u5 = bunching(df, keys, amount, 500_000).select(*keys, F.col("is_anomalous").alias("bunching_5lakh"))
    u10 = bunching(df, keys, amount, 1_000_000).select(*keys, F.col("is_anomalous").alias("bunching_10lakh"))
    totals = df.groupBy(*keys, unit).agg(F.sum(amount).alias("_t"))
    g = gini(totals, keys, "_t").select(*keys, "gini")
    out = b
    for part in (r, u5, u10, g):
        out = attach(out, part, keys)
    if anomaly_rate is None:
        out = out.withColumn("anomaly_rate", F.lit(None).cast("double"))
    else:
        out = attach(out, anomaly_rate.select(*keys, "anomaly_rate"), keys)

    def points(cond: Column, n: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)

    score = (
        points(F.col("benford"), 25) + points(F.col("round_number"), 20) + points(F.col("bunching_5lakh"), 20)
        + points(F.col("gini") > 0.6, 15) + points(F.col("anomaly_rate") > 0.15, 20)
    )
    return out.withColumn("risk_score", score).withColumn(
        "risk_level",
        F.when(F.col("risk_score") >= 70, "CRITICAL").when(F.col("risk_score") >= 50, "HIGH")
        .when(F.col("risk_score") >= 30, "MEDIUM").otherwise("LOW"),
    )
