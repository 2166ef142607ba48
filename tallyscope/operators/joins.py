"""Joins of the audit tables and the range, spatial and enrichment joins."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE, haversine_m
from ..session import durable

# Which analysis follows which kind of anomaly.
ROUTES = {
    "satellite_mismatch": ("SatelliteVerificationAgent", "CaseFileAgent"),
    "attendance_anomaly": ("MusterRollForensicsAgent", "CaseFileAgent"),
    "ghost_worker": ("MusterRollForensicsAgent", "PaymentPatternAgent", "CaseFileAgent"),
    "muster_roll_fraud": ("MusterRollForensicsAgent", "CaseFileAgent"),
    "payment_anomaly": ("PaymentPatternAgent", "CaseFileAgent"),
    "material_ratio_violation": ("PaymentPatternAgent", "CaseFileAgent"),
    "photo_anomaly": ("PhotoVerificationAgent", "CaseFileAgent"),
    "expenditure_anomaly": ("PaymentPatternAgent", "SatelliteVerificationAgent", "CaseFileAgent"),
}
DEFAULT_ROUTE = ("CaseFileAgent",)


def worker_profiles(
    cards: DataFrame, logs: DataFrame, musters: DataFrame, wages: DataFrame, audit: DataFrame
) -> DataFrame:
    """One row per job card with attendance, wage and identity facts.

    Each fact table is aggregated to one row per worker before the join.
    """
    bio = logs.groupBy("worker_id").agg(F.count(F.lit(1)).alias("auth_count"))
    att = musters.groupBy("worker_id").agg(F.sum("person_days").alias("total_days"), F.min("from_date").alias("first_work_date"))
    pay = wages.groupBy("worker_id").agg(F.sum("amount").alias("wages"), F.bool_or("is_dbt").alias("has_dbt"))
    return (
        cards.join(bio, "worker_id", "left").join(att, "worker_id", "left").join(pay, "worker_id", "left")
        .join(audit.select("aadhaar_number", F.col("flags").alias("aadhaar_flags")), "aadhaar_number", "left")
        .select(
            "worker_id", "job_card_number", "panchayat_id", "registration_date",
            F.coalesce("auth_count", F.lit(0)).alias("biometric_auth_count"),
            F.coalesce("total_days", F.lit(0)).alias("total_person_days"),
            F.coalesce("wages", F.lit(0)).cast("double").alias("total_wages"),
            F.coalesce("has_dbt", F.lit(True)).alias("has_dbt_payment"), "first_work_date", "aadhaar_flags",
        )
    )


def transfers(orders: DataFrame, works: DataFrame, panchayats: DataFrame, accounts: DataFrame, cards: DataFrame) -> DataFrame:
    """Fund transfers with their work and panchayat; account and worker when known."""
    return (
        orders.join(works, "work_id").join(panchayats, "panchayat")
        .join(accounts, "account", "left").join(cards, "worker_id", "left")
    )


def material_payments(payments: DataFrame, works: DataFrame, vendors: DataFrame, vendor_required: bool = False) -> DataFrame:
    """Material payments of known works; vendors optional or required."""
    return payments.join(works, "work_id").join(vendors, "vendor_id", "inner" if vendor_required else "left")


def account_map(orders: DataFrame, works: DataFrame, accounts: DataFrame) -> DataFrame:
    return orders.join(works, "work_id").join(accounts, "account", "left")


def wage_records(wages: DataFrame, musters: DataFrame, rates: DataFrame, works: DataFrame) -> DataFrame:
    """Wage payments with days worked and the daily rate of state and year."""
    return wages.join(musters, "muster_roll_id").join(rates, ["state_code", "financial_year"]).join(works, "work_id")


def attendance_between(attendance: DataFrame, works: DataFrame, day: str, start: str, end: str) -> DataFrame:
    span = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return attendance.filter(span).join(works, "work_id")


def results_of_year(results: DataFrame, works: DataFrame, year: str | None = None) -> DataFrame:
    """Verification results with the panchayat of their work, of one year or all."""
    w = works if year is None else works.filter(F.col("fin_year") == year)
    return results.join(w, "work_id")


def works_with_account_flag(works: DataFrame, accounts: DataFrame) -> DataFrame:
    flag = F.when(F.col("multi_panchayat"), True).otherwise(False)
    return works.join(accounts.select("account", "multi_panchayat"), "account", "left").withColumn(
        "multi_panchayat_account", flag
    ).drop("multi_panchayat")


def blocks_with_risk(blocks: DataFrame, scores: DataFrame, since: str) -> DataFrame:
    """All blocks; a score counts only when scanned since the given date."""
    recent = (blocks["block_id"] == scores["block_id"]) & (scores["scan_date"] >= F.lit(since).cast("date"))
    return (
        blocks.join(scores, recent, "left")
        .select(
            blocks["*"], F.coalesce("risk_level", F.lit("low")).alias("risk_level"),
            F.coalesce("flagged_works", F.lit(0)).alias("flagged_works"), "risk_score",
        )
        .orderBy(F.col("risk_score").desc_nulls_last(), F.col("block_id"))
    )


def enrich(base: DataFrame, updates: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Overwrite fields of records by case-insensitive keys; the last duplicate wins."""
    up = [F.upper(F.trim(F.col(k))).alias(f"_{k}") for k in keys]
    last = (
        updates.select(*up, *fields, *order).groupBy(*[f"_{k}" for k in keys])
        .agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_new"))
    )
    keyed = base.withColumns({f"_{k}": F.upper(F.trim(F.col(k))) for k in keys})
    out = keyed.join(last, [f"_{k}" for k in keys], "left")
    return out.withColumns({f: F.coalesce(F.col("_new")[f], F.col(f)) for f in fields}).withColumn(
        "is_updated", F.col("_new").isNotNull()
    ).drop("_new", *[f"_{k}" for k in keys])


def members_of(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is in a list table."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def route(df: DataFrame, kind: str, routes: Mapping[str, Sequence[str]] = ROUTES, default: Sequence[str] = DEFAULT_ROUTE) -> DataFrame:
    """Follow-up analyses per anomaly from a constant table; unknown kinds take the default."""
    pairs: list[Column] = []
    for k, names in routes.items():
        pairs += [F.lit(k), F.array(*[F.lit(n) for n in names])]
    return df.withColumn("agents", F.coalesce(F.create_map(*pairs)[F.col(kind)], F.array(*[F.lit(n) for n in default])))


def relevant_steps(df: DataFrame, keys: Sequence[str], kinds: str, triggers: Mapping[str, Sequence[str]]) -> DataFrame:
    """Steps triggered by any kind of a case; all steps when none is."""
    hits = F.array_compact(F.array(*[
        F.when(F.arrays_overlap(F.col(kinds), F.array(*[F.lit(k) for k in ks])), step) for step, ks in triggers.items()
    ]))
    everything = F.array(*[F.lit(s) for s in triggers])
    return df.select(*keys, F.when(F.size(hits) > 0, hits).otherwise(everything).alias("steps"))


# -- scenes around works ----------------------------------------------------------------

def best_scenes(
    works: DataFrame,
    scenes: DataFrame,
    tile: str,
    work_id: str,
    start: str,
    end: str,
    *,
    before: tuple[int, int] = (60, 5),
    after: tuple[int, int] = (5, 60),
    max_cloud: float = 30.0,
) -> DataFrame:
    """Clearest scene in the window before the start and after the end of each work.

    ``scenes`` has ``tile, scene_id, scene_day, cloud``. Since only the clearest
    scene counts, scenes are first reduced to one per tile and day; the range join
    on (tile, month) then meets at most 31 rows per key, however many scenes a
    tile has. Works of a tile and day ask for the same windows, so it is windows that
    meet scenes, each once, and works look up the answer: windows are bounded by tiles
    and days.
    """
    daily = (
        scenes.filter(F.col("cloud") <= max_cloud).groupBy(tile, "scene_day")
        .agg(F.min(F.struct("cloud", "scene_id")).alias("_best"))
        .withColumn("_month", F.trunc("scene_day", "month"))
    )
    windows = F.array(
        F.struct(F.lit("before").alias("phase"), F.date_sub(F.col(start), before[0]).alias("lo"), F.date_sub(F.col(start), before[1]).alias("hi")),
        F.struct(F.lit("after").alias("phase"), F.date_add(F.col(end), after[0]).alias("lo"), F.date_add(F.col(end), after[1]).alias("hi")),
    )
    asked = works.select(work_id, tile, F.inline(windows))
    window = ["phase", tile, "lo", "hi"]
    met = asked.select(*window).distinct().withColumn(
        "_month", F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month")))
    )
    best = F.min(F.struct("_best.cloud", "scene_day", "_best.scene_id"))
    # written, so that their size is known before works are shuffled
    found = durable(
        met.join(daily, [tile, "_month"]).filter(F.col("scene_day").between(F.col("lo"), F.col("hi")))
        .groupBy(*window).agg(best.alias("_b"))
    )
    # a work id may repeat, with windows of its own each time
    return (
        asked.join(found, window).groupBy(work_id, "phase").agg(F.min("_b").alias("_b"))
        .select(work_id, "phase", "_b.scene_id", "_b.scene_day", "_b.cloud")
    )


def scene_pairs(best: DataFrame, work_id: str) -> DataFrame:
    """Works that have both a before and an after scene."""
    b = best.filter("phase = 'before'").select(work_id, F.col("scene_id").alias("before_scene"), F.col("cloud").alias("before_cloud"))
    a = best.filter("phase = 'after'").select(work_id, F.col("scene_id").alias("after_scene"), F.col("cloud").alias("after_cloud"))
    return b.join(a, work_id)


# -- measures and places ------------------------------------------------------------------

def compare_measures(detected: DataFrame, reported: DataFrame, keys: Sequence[str], warn: float = 20, crit: float = 50) -> DataFrame:
    """Detected against reported values, with the side that is missing flagged."""
    both = detected.join(reported, list(keys), "full")
    d, r = F.col("detected"), F.col("reported")
    pct = F.when(r != 0, 100 * F.abs(d - r) / F.abs(r)).when(d != 0, 100.0).otherwise(0.0)
    known = d.isNotNull() & r.isNotNull()
    return (
        both.withColumn("difference", d - r)
        .withColumn("pct_deviation", F.when(known, pct))
        .withColumn(
            "flag",
            F.when(~known, "MISSING_DATA").when(F.col("pct_deviation") > crit, "CRITICAL")
            .when(F.col("pct_deviation") > warn, "WARNING").otherwise("OK"),
        )
    )


def within_distance(points: DataFrame, sites: DataFrame, radius_m: float) -> DataFrame:
    """Point-site pairs within a radius, anywhere on the globe.

    ``points`` has ``point_id, lat, lon``; ``sites`` has ``site_id, site_lat,
    site_lon``. Bands of latitude are one radius high and cut into whole cells that
    are about one radius wide in their band. A site is listed in every cell that its
    circle's box touches in its own and the two bands beside it, across the 180th
    meridian and around the poles; a point joins on its one cell.
    """
    high = radius_m / METRES_PER_DEGREE * 1.01
    reach = radius_m / EARTH_RADIUS_M * 1.0001

    def cells(band: Column) -> Column:
        widest = F.least(F.greatest(F.abs(band * high), F.abs((band + 1) * high)), F.lit(90.0))
        return F.greatest(F.floor(360.0 * F.cos(F.radians(widest)) / high), F.lit(1)).cast("long")

    def column(lon: Column, band: Column) -> Column:
        return F.floor((lon + 180.0) * cells(band) / 360.0).cast("long")

    sine = F.sin(F.lit(min(reach, math.pi / 2))) / F.greatest(F.cos(F.radians("site_lat")), F.lit(1e-12))
    pole = F.abs(F.radians("site_lat")) + reach >= math.pi / 2
    wide = F.when(pole | (sine >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))) * 1.0001)
    band = F.floor(F.col("site_lat") / high).cast("long")
    around = sites.withColumn("_cy", F.explode(F.sequence(band - 1, band + 1))).withColumn("_k", cells(F.col("_cy")))
    first, last = column(F.col("site_lon") - wide, F.col("_cy")), column(F.col("site_lon") + wide, F.col("_cy"))
    around = around.withColumn("_cx", F.explode(F.sequence(first, F.least(last, first + F.col("_k") - 1)))).withColumn("_cx", F.pmod("_cx", "_k")).drop("_k")
    placed = points.withColumn("_cy", F.floor(F.col("lat") / high).cast("long"))
    placed = placed.withColumn("_cx", F.pmod(column(F.col("lon"), F.col("_cy")), cells(F.col("_cy"))))
    dist = haversine_m(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon"))
    return placed.join(around, ["_cy", "_cx"]).withColumn("distance_m", dist).filter(F.col("distance_m") <= radius_m).drop("_cy", "_cx")
