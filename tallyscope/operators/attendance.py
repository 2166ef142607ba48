"""Attendance and worker detectors."""

from __future__ import annotations

import math

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import non_working_reason
from ..functions.geo import haversine_m
from .sequences import day_streaks
from .similarity import first_fit, jaccard_pairs, set_classes

# Weight of each sign of a worker who may not exist.
GHOST_WEIGHTS = {
    "zero_biometric_authentication": 0.9,
    "negligible_biometric_authentication": 0.7,
    "only_high_expenditure_works": 0.6,
    "no_dbt_payment_despite_wages": 0.5,
    "immediate_high_engagement_after_registration": 0.5,
    "aadhaar_linked_multiple_panchayats": 0.8,
    "sequential_aadhaar_number": 0.7,
}


# -- clones ---------------------------------------------------------------------

def clone_groups(df: DataFrame, work: str, worker: str, day: str, threshold: float = 0.90) -> DataFrame:
    """Groups of workers of a work whose attendance days nearly coincide.

    Returns one row per group: leader (earliest member), size, days of the work,
    days on which all members agree (all present or all absent), and the implied
    false person-days. :func:`clone_members` lists the members.
    """
    return _clones(df, work, worker, day, threshold)[0]


def clone_members(df: DataFrame, work: str, worker: str, day: str, threshold: float = 0.90) -> DataFrame:
    return _clones(df, work, worker, day, threshold)[1]


def _clones(df: DataFrame, work: str, worker: str, day: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    # workers are visited in order of first day, then id
    first = df.groupBy(work, worker).agg(F.min(day).alias("_first"))
    rows = df.select(work, worker, day).distinct().join(first, [work, worker]).select(
        work, F.struct("_first", worker).alias("_who"), day
    )
    classes, membership = set_classes(rows, [work], "_who", day)
    pairs = jaccard_pairs(rows, [work], "_who", day, threshold)
    grouped = first_fit(pairs.filter("a != b"), [work])
    alone = membership.filter((F.col("_who") == F.col("rep")) & (F.col("members") > 1)).select(
        work, F.col("rep").alias("v")
    ).join(grouped, [work, "v"], "left_anti").withColumn("leader", F.col("v"))
    leaders = grouped.unionByName(alone)
    members = membership.join(leaders.withColumnRenamed("v", "rep"), [work, "rep"])
    sizes = members.groupBy(work, "leader").agg(F.count(F.lit(1)).alias("workers"))
    sizes = sizes.filter("workers >= 2")
    days = df.groupBy(work).agg(F.count_distinct(day).alias("total_days"))
    # per group and day: how many members were present, weighting classes by their size
    reps = members.filter(F.col("_who") == F.col("rep")).select(work, "leader", F.col("rep").alias("_who"), "members")
    present = reps.join(classes, [work, "_who"]).groupBy(work, "leader", day).agg(F.sum("members").alias("_p"))
    agree = present.join(sizes, [work, "leader"]).groupBy(work, "leader").agg(
        F.count_if(F.col("_p") == F.col("workers")).alias("_all"), F.count(F.lit(1)).alias("_any")
    )
    match = F.col("_all") + F.col("total_days") - F.col("_any")
    groups = (
        sizes.join(agree, [work, "leader"]).join(days, work)
        .select(
            work, F.col(f"leader.{worker}").alias("leader"), "workers", "total_days", match.alias("matching_days"),
            (match / F.greatest("total_days", F.lit(1))).alias("overlap_pct"),
            (match * (F.col("workers") - 1)).alias("fake_person_days"),
        )
    )
    kept = members.join(sizes.select(work, "leader"), [work, "leader"], "left_semi")
    return groups, kept.select(work, F.col(f"leader.{worker}").alias("leader"), F.col(f"_who.{worker}").alias(worker))


# -- ghosts ---------------------------------------------------------------------

def high_works_only(musters: DataFrame, works: DataFrame, amount: str, above: float = 500_000) -> DataFrame:
    """Workers all of whose two or more works spent more than a limit."""
    linked = musters.select("worker_id", "work_id").distinct().join(works.select("work_id", amount), "work_id")
    return linked.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("linked_works"), F.count_if(F.col(amount) > above).alias("_high")
    ).select("worker_id", "linked_works", ((F.col("linked_works") >= 2) & (F.col("_high") == F.col("linked_works"))).alias("high_only"))


def ghost_workers(profiles: DataFrame) -> DataFrame:
    """Workers with two signs of not existing, or one strong sign.

    ``profiles`` is the worker profile table with ``high_only`` added.
    """
    days, bio = F.col("total_person_days"), F.col("biometric_auth_count")
    flags = F.coalesce("aadhaar_flags", F.array().cast("array<string>"))
    gap = F.date_diff("first_work_date", "registration_date")
    tests = {
        "zero_biometric_authentication": (days > 0) & (bio == 0),
        "negligible_biometric_authentication": ~((days > 0) & (bio == 0)) & (days > 20) & (bio < 3),
        "only_high_expenditure_works": F.col("high_only"),
        "no_dbt_payment_despite_wages": ~F.col("has_dbt_payment") & (F.col("total_wages") > 0),
        "immediate_high_engagement_after_registration": (gap < 2) & (days > 30),
        "aadhaar_linked_multiple_panchayats": F.array_contains(flags, "multi_panchayat"),
        "sequential_aadhaar_number": F.array_contains(flags, "sequential_number"),
    }
    signs = F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("name"), F.lit(GHOST_WEIGHTS[name]).alias("weight")))
        for name, cond in tests.items()
    ]))
    n = F.size("_signs")
    total = F.aggregate("_signs", F.lit(0.0), lambda s, x: s + x["weight"])
    return (
        profiles.withColumn("_signs", signs)
        .filter((n >= 2) | ((n == 1) & (F.get("_signs", F.lit(0))["weight"] >= 0.8)))
        .withColumn("indicators", F.transform("_signs", lambda x: x["name"]))
        .withColumn("confidence", total / n)
        .withColumn("severity", F.when(F.col("confidence") > 0.8, "critical").otherwise("high"))
        .drop("_signs")
    )


# -- one worker, several sites on a day -----------------------------------------------

def _hull(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Indices of points that can be an end of the longest great-circle distance.

    In a gnomonic view great circles are straight, so these are the corners of the
    convex hull, as long as no two points are more than a quarter of the globe apart.
    That holds within 45 degrees of a centre; points spread wider are all kept.
    """
    la, lo = np.radians(lat), np.radians(lon)
    xyz = np.c_[np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)]
    mid = xyz.mean(axis=0)
    norm = np.linalg.norm(mid)
    if norm < 1e-6 or (xyz @ (mid / norm)).min() < math.cos(math.radians(45)) + 1e-9:
        return np.arange(len(lat))
    mid = mid / norm
    east = np.cross([0.0, 0.0, 1.0], mid)
    if np.linalg.norm(east) < 1e-9:
        east = np.array([1.0, 0.0, 0.0])
    east /= np.linalg.norm(east)
    north = np.cross(mid, east)
    w = xyz @ mid
    x, y = (xyz @ east) / w, (xyz @ north) / w
    order = np.lexsort((y, x))

    def half(idx: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in idx:
            while len(out) >= 2:
                o, a = out[-2], out[-1]
                if (x[a] - x[o]) * (y[i] - y[o]) - (y[a] - y[o]) * (x[i] - x[o]) < -1e-12:
                    out.pop()
                else:
                    break
            out.append(int(i))
        return out

    return np.unique(half(order) + half(order[::-1]))


def max_spread(df: DataFrame, keys: Sequence[str], lat: str, lon: str, direct: int = 64, chunk: int = 20_000) -> DataFrame:
    """Longest great-circle distance in km between the places of a key.

    Small keys compare their places directly. A key with many places is cut into
    chunks, each reduced to its hull corners; corners of all chunks then compare.
    ``direct`` and ``chunk`` set the way only: both ways are exact.
    """
    keys = list(keys)
    places = df.filter((F.col(lat) != 0) & (F.col(lon) != 0)).select(*keys, F.col(lat).alias("_la"), F.col(lon).alias("_lo")).distinct()
    sized = places.join(places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    few = sized.filter(F.col("_n") <= direct).select(*keys, "_la", "_lo")
    many = sized.filter(F.col("_n") > direct).withColumn(
        "_slice", F.pmod(F.xxhash64("_la", "_lo"), F.ceil(F.col("_n") / chunk))
    )
    schema = few.schema

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = _hull(pdf["_la"].to_numpy(), pdf["_lo"].to_numpy())
        return pdf.iloc[keep][[f.name for f in schema.fields]]

    reduced = few.unionByName(many.select(*keys, "_la", "_lo", "_slice").groupBy(*keys, "_slice").applyInPandas(corners, schema))
    other = reduced.select(*keys, F.col("_la").alias("_lb"), F.col("_lo").alias("_lp"))
    dist = haversine_m(F.col("_la"), F.col("_lo"), F.col("_lb"), F.col("_lp")) / 1000
    pairs = reduced.join(other, keys).filter((F.col("_la") < F.col("_lb")) | ((F.col("_la") == F.col("_lb")) & (F.col("_lo") < F.col("_lp"))))
    return pairs.groupBy(*keys).agg(F.max(dist).alias("distance_km"))


def multi_site_days(df: DataFrame, worker: str, day: str, site: str, lat: str, lon: str) -> DataFrame:
    """Days on which a worker is present at more than one site."""
    keys = [worker, day]
    rows = df.select(*keys, site, lat, lon).distinct()
    several = rows.select(*keys, site).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("sites")).filter("sites > 1")
    spread = max_spread(rows.join(several, keys, "left_semi"), keys, lat, lon)
    km = F.round(F.coalesce("distance_km", F.lit(0.0)), 1)
    return (
        several.join(spread, keys, "left").withColumn("distance_km", km)
        .withColumn(
            "severity",
            F.when(F.col("distance_km") > 50, "critical").when(F.col("distance_km") > 10, "high").otherwise("medium"),
        )
        .withColumn("confidence", F.lit(0.95))
    )


# -- plausibility ---------------------------------------------------------------------

def monsoon_earthwork(df: DataFrame, day: str, days: str, category: str, earthwork: str = "earthwork", above: float = 5) -> DataFrame:
    """Earthwork of more than a few person-days in June to September."""
    month = F.month(F.col(day))
    return df.filter((F.col(category) == earthwork) & month.between(6, 9) & (F.col(days) > above)).withColumns(
        {"month": month, "severity": F.lit("high"), "confidence": F.lit(0.85)}
    )


def wage_mismatches(df: DataFrame, days: str, rate: str, paid: str, tolerance_pct: float = 5.0) -> DataFrame:
    """Payments away from days times rate by more than the tolerance."""
    expected = F.col(days) * F.col(rate)
    pct = F.abs(F.col(paid) - F.col("expected_payment")) / F.col("expected_payment") * 100
    return (
        df.withColumn("expected_payment", expected.cast("double")).filter(F.col("expected_payment") > 0)
        .withColumn("deviation_pct", pct).filter(F.col("deviation_pct") > tolerance_pct)
        .withColumn("severity", F.when(F.col("deviation_pct") > 20, "high").otherwise("medium"))
        .withColumn("confidence", F.least(F.col("deviation_pct") / 50, F.lit(1.0)))
    )


def suspicious_dates(
    df: DataFrame, keys: Sequence[str], day: str, *, as_of: str, start: str | None = None, end: str | None = None,
    longest_streak: int = 14,
) -> DataFrame:
    """Attendance on rest days, in the future, outside the work, or without a break.

    One row per key, kind and (for streaks) streak: number of dates, first, last.
    """
    keys = list(keys)
    extra = [c for c in (start, end) if c]
    rows = df.select(*keys, F.col(day).alias("_d"), *extra).distinct()
    reason = non_working_reason(F.col("_d"))
    outside = F.lit(False)
    if start:
        outside = outside | F.coalesce(F.col("_d") < F.col(start), F.lit(False))
    if end:
        outside = outside | F.coalesce(F.col("_d") > F.col(end), F.lit(False))
    kinds = F.array_compact(F.array(
        F.when(reason == "Sunday", "weekend_attendance").when(reason.endswith("Saturday"), "non_working_saturday_attendance")
        .when(reason.isNotNull(), "holiday_attendance"),
        F.when(F.col("_d") > F.lit(as_of).cast("date"), "future_dated_attendance"),
        F.when(outside, "out_of_range_attendance"),
    ))
    simple = (
        rows.select(*keys, "_d", F.explode(kinds).alias("finding_type")).groupBy(*keys, "finding_type")
        .agg(F.count_distinct("_d").alias("dates"), F.min("_d").alias("first_date"), F.max("_d").alias("last_date"))
    )
    streaks = day_streaks(df, keys, day, longest_streak).select(
        *keys, F.lit("impossible_attendance_streak").alias("finding_type"), F.col("days").alias("dates"),
        F.col("streak_start").alias("first_date"), F.col("streak_end").alias("last_date"),
    )
    severity = (
        F.when(F.col("finding_type").isin("impossible_attendance_streak", "future_dated_attendance"), "critical")
        .when(F.col("finding_type") == "non_working_saturday_attendance", "medium").otherwise("high")
    )
    return simple.unionByName(streaks).withColumn("severity", severity)
