"""Evidence, case and report tables, and the dashboards built on findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import haversine_m
from ..operators.sequences import mode_per_group, primary_per_group
from ..ordered import scan
from ..session import durable

# Action codes for kinds of anomaly found in a case.
ACTIONS = {
    "satellite_mismatch": "independent_field_verification", "ghost_worker": "biometric_verification", "attendance_anomaly": "biometric_verification",
    "payment_anomaly": "freeze_accounts_and_audit_orders", "photo_anomaly": "retake_geotagged_photos", "material_ratio_violation": "audit_material_procurement",
}
ALWAYS = ("show_cause_notice", "report_to_state_council")
# Allowed status changes.
TRANSITIONS = {"flagged": ("investigating",), "investigating": ("confirmed", "dismissed")}


# -- evidence -----------------------------------------------------------------------

def evidence_chain(items: DataFrame, case: str = "case_id") -> DataFrame:
    """Types, primaries, mean confidence and strength of every case's evidence."""
    prim = primary_per_group(items, [case, "evidence_type"], "confidence", "collected_at", "evidence_id")
    per = prim.groupBy(case).agg(
        F.count(F.lit(1)).alias("evidence_types"), F.array_sort(F.collect_list(F.struct("evidence_type", "evidence_id"))).alias("primaries")
    )
    tot = items.groupBy(case).agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))
    m, n = F.col("mean_confidence"), F.col("evidence_types")
    strength = F.when((n >= 3) & (m >= 0.7), "strong").when((n >= 2) & (m >= 0.5), "moderate").otherwise("weak")
    return tot.join(per, case).withColumn("strength", strength)


def case_files(anomalies: DataFrame, case: str, *, kind: str, loss: str, worker: str) -> DataFrame:
    """Loss, affected workers, kinds and actions of every case."""
    pairs: list[Column] = []
    for k, v in ACTIONS.items():
        pairs += [F.lit(k), F.lit(v)]
    kinds = anomalies.select(case, kind).distinct().groupBy(case).agg(F.array_sort(F.collect_list(kind)).alias("kinds"))
    workers = anomalies.select(case, worker).distinct().groupBy(case).agg(F.count(worker).alias("affected_workers"))
    out = anomalies.groupBy(case).agg(F.count(F.lit(1)).alias("anomalies"), F.sum(loss).alias("estimated_loss")).join(kinds, case).join(workers, case)
    rule = F.create_map(*pairs)
    acts = F.array_distinct(F.array_compact(F.transform("kinds", lambda k: rule[k])))
    return out.withColumn("actions", F.concat(acts, F.array(*[F.lit(a) for a in ALWAYS])))


def case_financials(evidence: DataFrame, case: str, amount: str) -> DataFrame:
    """Last amount per evidence type and the total of a case."""
    last = evidence.groupBy(case, "evidence_type").agg(F.max_by(amount, F.struct("collected_at", "evidence_id")).alias("amount"))
    total = last.groupBy(case).agg(F.sum("amount").alias("case_total"))
    return last.join(total, case)


# The rule that a kind of anomaly breaks.
CRITERIA = {
    "satellite_mismatch": "Section 17(1)",
    "ghost_worker": "Section 25, Para 19.4",
    "payment_anomaly": "Para 7.7",
    "material_ratio_violation": "Section 4(3)",
    "attendance_anomaly": "Para 17.3",
}
CAUSES = ("weak_supervision", "no_live_monitoring", "weak_biometric_checks", "possible_collusion")
RECOMMENDATIONS = ("recover_irregular_payments", "fix_accountability", "geotag_monitoring", "biometric_attendance")


def observations(cases: DataFrame, case: str, chapter: str = "4.2") -> DataFrame:
    """Audit observation per case: number, criteria, condition, cause, effect and recommendation.

    The criteria are those of the kinds found, the general rule where none of them has one.
    """
    rule = F.create_map(*[F.lit(x) for pair in CRITERIA.items() for x in pair])
    broken = F.array_compact(F.transform("kinds", lambda k: rule[k]))
    return cases.select(
        case, F.concat(F.lit(f"{chapter}."), F.expr(f"right(cast(`{case}` as string), 3)")).alias("para"),
        F.when(F.size(broken) > 0, F.array_join(broken, " | ")).otherwise("general").alias("criteria"),
        F.array_join("kinds", ", ").alias("condition"), F.lit(", ".join(CAUSES)).alias("cause"),
        F.col("estimated_loss").alias("effect"), F.col("affected_workers"), F.lit(", ".join(RECOMMENDATIONS)).alias("recommendation"),
    )


def paragraphs(summary: DataFrame, ranked: DataFrame, keys: Sequence[str], *, severity: str, amount: str, ref: str, top: int = 10) -> DataFrame:
    """Draft paragraphs per key, numbered through: an opening, the gravest findings, and one on discrepant works.

    ``summary`` has ``flagged`` and ``leakage`` per key, ``ranked`` comes from
    :func:`top_findings`. The last paragraph is left out where no work is discrepant.
    """
    keys = list(keys)
    opening = summary.select(*keys, F.lit(1).alias("para_no"), F.lit("executive_observation").alias("heading"), F.lit(None).cast("string").alias("ref"), F.col("leakage").cast("double").alias("amount"))
    kept = ranked.filter(F.col("rank") <= top)
    body = kept.select(*keys, (F.col("rank") + 1).alias("para_no"), F.concat(F.lit("anomaly_"), F.lower(severity)).alias("heading"), F.col(ref).cast("string").alias("ref"), F.col(amount).cast("double").alias("amount"))
    n = kept.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    closing = summary.filter("flagged > 0").join(n, keys, "left").select(
        *keys, (F.coalesce("_n", F.lit(0)) + 2).alias("para_no"), F.lit("satellite_discrepancies").alias("heading"), F.col("flagged").cast("string").alias("ref"), F.lit(None).cast("double").alias("amount"))
    return opening.unionByName(body).unionByName(closing)


def numbered_paragraphs(df: DataFrame, keys: Sequence[str], amount: str, tie: str, top: int = 10) -> DataFrame:
    """The largest observations per key, numbered from 1.

    The rank filter lets Spark cut every task to its own top rows before the
    shuffle, so a key with very many rows sends only a few.
    """
    w = W.partitionBy(*keys).orderBy(F.col(amount).desc(), F.col(tie))
    ranked = df.withColumn("para_no", F.row_number().over(w))
    return ranked.filter(F.col("para_no") <= top)


#: Order of severities in a report.
SEVERITIES = ("critical", "high", "medium", "low")


def top_findings(df: DataFrame, keys: Sequence[str], severity: str, amount: str, tie: str, top: int = 20) -> DataFrame:
    """The ``top`` findings per key, gravest first, then by amount, numbered from 1."""
    grade = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(severity))
    grade = F.when(F.coalesce(grade, F.lit(0)) == 0, len(SEVERITIES) + 1).otherwise(grade)
    w = W.partitionBy(*keys).orderBy(grade, F.col(amount).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


# -- districts ------------------------------------------------------------------------

def district_report(checks: DataFrame, keys: Sequence[str], *, reported: str, detected: str, status: str) -> DataFrame:
    """Verified share, leakage over discrepant works and level."""
    bad = F.col(status) == "DISCREPANT"
    out = checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("works"), F.count_if(F.col(status) == "VERIFIED").alias("verified"), F.count_if(bad).alias("flagged"),
        F.sum(reported).alias("_exp"), F.sum(F.when(bad, F.abs(F.col(reported) - F.col(detected))).otherwise(0)).alias("leakage"),
    )
    pct = 100 * F.col("leakage") / F.greatest(F.col("_exp"), F.lit(1.0))
    return out.withColumns({"verified_pct": 100 * F.col("verified") / F.col("works"), "leakage_pct": pct}).withColumn(
        "risk_level",
        F.when((F.col("leakage_pct") > 20) | (F.col("flagged") > F.col("works") * 0.3), "CRITICAL").when(F.col("leakage_pct") > 10, "HIGH")
        .when(F.col("leakage_pct") > 5, "MEDIUM").otherwise("LOW"),
    ).drop("_exp")


def leakage_estimate(sample: DataFrame, keys: Sequence[str], *, reported: str, detected: str, population: Column, total: Column) -> DataFrame:
    """Ratio estimate of leakage with a 95 % interval from a verified sample."""
    gap = F.greatest(F.col(reported) - F.col(detected), F.lit(0.0))
    s = sample.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(gap).alias("_g"), F.sum(reported).alias("_r"), F.coalesce(F.stddev_samp(gap), F.lit(0.0)).alias("_sd"),
        F.first(population).alias("_N"), F.first(total).alias("_T"),
    )
    ratio = F.when(F.col("_r") > 0, F.col("_g") / F.when(F.col("_r") > 0, F.col("_r"))).otherwise(0.0)
    half = 1.96 * F.col("_sd") / F.sqrt("n") * F.col("_N")
    out = s.withColumn("leakage_ratio", ratio).withColumn("estimate", F.col("leakage_ratio") * F.col("_T"))
    return out.withColumn("low", F.greatest(F.col("estimate") - half, F.lit(0.0))).withColumn("high", F.col("estimate") + half).drop("_g", "_r", "_sd", "_N", "_T")


def action_items(stats: DataFrame) -> DataFrame:
    """Briefing actions from the counts of a district."""
    return stats.withColumn("actions", F.array_compact(F.array(
        F.when(F.col("open_cases") > 10, "review_meeting"), F.when(F.col("flagged_works") > 50, "deploy_verification_teams"),
        F.lit("geotag_all_new_works"), F.lit("update_schedule_of_rates"),
    )))


def briefing(stats: DataFrame, kinds: DataFrame, blocks: DataFrame, key: str, kind: str) -> DataFrame:
    """``stats`` of a district with its most frequent kinds, the risk of its blocks, and key findings.

    ``kinds`` has (key, ``kind``, count, rank), few a district; ``blocks`` (key, block_id,
    risk_level, risk_score).
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", F.col(kind), F.col("count").cast("string")).alias("shown"))))
    top = kinds.groupBy(key).agg(F.transform(listed, lambda x: x["shown"]).alias("top_kinds"))
    scored = F.when(F.col("risk_score").isNotNull(), F.struct("risk_score", (-F.col("block_id")).alias("_b")))
    risk = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("risk_level") == "high").alias("high_risk_blocks"), F.max_by("block_id", scored).alias("worst_block"))
    out = action_items(stats).join(top, key, "left").join(risk, key, "left")
    return out.withColumn("key_findings", F.array_compact(F.array(
        F.when(F.col("open_cases") > 0, F.concat(F.lit("open_cases:"), F.col("open_cases").cast("string"))),
        F.when(F.size("top_kinds") > 0, F.concat(F.lit("most_frequent:"), F.col("top_kinds")[0])),
        F.when(F.col("high_risk_blocks") > 0, F.concat(F.lit("high_risk_blocks:"), F.col("high_risk_blocks").cast("string"))),
    )))


def weekly_highlights(weekly: DataFrame) -> DataFrame:
    """Weekly rows marked when more is found than settled or something escalates."""
    return weekly.withColumn("highlights", F.array_compact(F.array(
        F.when(F.col("new_anomalies") > F.col("resolved_cases"), "backlog_growing"), F.when(F.col("escalated_cases") > 0, "escalations"),
    )))


# -- contracts -------------------------------------------------------------------------

def monthly_trend(df: DataFrame, when: str, kind: str, kinds: Sequence[str], amount: str) -> DataFrame:
    """Count and amount per month, counts split by kind."""
    base = df.withColumn("month", F.date_format(when, "yyyy-MM"))
    return base.groupBy("month").agg(
        F.count(F.lit(1)).alias("total"), F.sum(amount).alias("amount"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    )


def hotspots(df: DataFrame, lat: str, lon: str, kind: str, place: str, cell: float = 1.0, at_least: int = 2) -> DataFrame:
    """Grid cells with their centre, radius, dominant kind and places."""
    base = df.withColumn("cell_y", F.floor(F.col(lat) / cell)).withColumn("cell_x", F.floor(F.col(lon) / cell))
    key = ["cell_y", "cell_x"]
    core = base.groupBy(*key).agg(F.count(F.lit(1)).alias("count"), F.avg(lat).alias("centre_lat"), F.avg(lon).alias("centre_lon")).filter(F.col("count") >= at_least)
    far = base.join(core, key).groupBy(*key).agg((F.max(haversine_m(F.col(lat), F.col(lon), F.col("centre_lat"), F.col("centre_lon"))) / 1000).alias("radius_km"))
    main = mode_per_group(base, key, kind).select(*key, F.col(kind).alias("dominant"))
    places = base.select(*key, place).distinct().groupBy(*key).agg(F.count(place).alias("places"))
    return core.join(far, key).join(main, key).join(places, key)


def repeated_payments(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Same key paid the same amount more than once."""
    return df.groupBy(*keys, amount).agg(F.count(F.lit(1)).alias("payments")).filter("payments > 1")


def account_runs(df: DataFrame, keys: Sequence[str], number: str, at_least: int = 3) -> DataFrame:
    """Runs of successive account numbers paid under one key (a date).

    Distinct numbers only; a run is named by number minus rank, scanned in slices
    of the number range.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(number).cast("long").alias("_n")).distinct()
    ranked = scan(rows, keys, [F.col("_n")], F.floor(F.col("_n") / 100_000), row_number="_r")
    runs = ranked.groupBy(*keys, (F.col("_n") - F.col("_r")).alias("_g")).agg(
        F.min("_n").alias("first_number"), F.max("_n").alias("last_number"), F.count(F.lit(1)).alias("accounts")
    )
    return runs.filter(F.col("accounts") >= at_least).drop("_g")


def shared_accounts(df: DataFrame, account: str, holder: str) -> DataFrame:
    pairs = df.select(account, holder).distinct()
    return pairs.groupBy(account).agg(F.count(holder).alias("holders")).filter("holders > 1")


def against_peers(df: DataFrame, kind: str, spent: str, progress: str) -> DataFrame:
    """Spending per unit of progress relative to the mean of works of the kind.

    The means are written once: their size is known then, and where kinds are few they go
    to the works, which are not brought together by kind.
    """
    rated = df.filter(F.col(progress) > 0).withColumn("ratio", F.col(spent) / F.col(progress))
    mean = durable(rated.groupBy(kind).agg(F.avg("ratio").alias("peer_ratio")))
    return rated.join(mean, kind).withColumn("relative", F.col("ratio") / F.col("peer_ratio"))


def implausible_workers(workers: DataFrame, deceased: DataFrame, key: str, age: str, oldest: int = 100) -> DataFrame:
    """Workers above an age or on the register of deaths."""
    old = workers.filter(F.col(age) > oldest).withColumn("reason", F.lit("age"))
    dead = workers.join(deceased.select(key).distinct(), key, "left_semi").withColumn("reason", F.lit("deceased"))
    return old.unionByName(dead)


def transition(current: DataFrame, updates: DataFrame, key: str, rules: Mapping[str, Sequence[str]] = TRANSITIONS) -> DataFrame:
    """Apply status changes that the rules allow; others leave the record as it was."""
    joined = current.join(updates.select(key, F.col("status").alias("_to")), key, "left")
    ok = F.lit(False)
    for a, targets in rules.items():
        ok = ok | ((F.col("status") == a) & F.col("_to").isin(*targets))
    ok = F.coalesce(ok, F.lit(False))
    return joined.withColumn("accepted", F.when(F.col("_to").isNotNull(), ok)).withColumn(
        "status", F.when(ok, F.col("_to")).otherwise(F.col("status"))).drop("_to")
