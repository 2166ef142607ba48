"""Scores, cases, reports and dashboards on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import payments as P
from ..operators import photos, raster, rollup, stats
from ..operators.sequences import latest_per_key, period_change
from ..plans import findings, reports, risk
from ..session import spread
from . import joins, pictures, rasters, relational, roles
from .audits import _WORK_COST, work_costs
from .base import REGISTRY, Tables, query, rnd
from .roles import ANOMALIES, PANCHAYATS, PAYMENTS, WORKS
from .scalars import spot, spot_sql
from .statistics import EXPENDITURE, _digit_cte, _CHI, _WHOLE


def musters(t: Tables) -> DataFrame:
    return roles.payments(t).select(
        "panchayat", F.col("quantity").alias("person_days"), (F.col("quantity") * (F.col("worker_id") % 10) / 10).alias("verified"), "material_type", "paid_on"
    )


_K1 = (PAYMENTS + ", " + _digit_cte("SELECT panchayat AS k, quantity AS v FROM payments WHERE quantity > 0", _WHOLE).replace("WITH ", "", 1)
       + ", db AS (SELECT k, CASE WHEN n >= 10 THEN least((" + _CHI + ")/0.1, 1) ELSE 0 END AS b FROM cnt), "
       "mu AS (SELECT panchayat, sum(quantity) AS t, sum(quantity*(worker_id % 10)/10) AS v, count(*) FILTER (WHERE month(paid_on) BETWEEN 6 AND 9 AND material_type = 'R' AND quantity > 50)*1.0::DOUBLE/count(*) AS m FROM payments GROUP BY 1), "
       "att AS (SELECT panchayat, (b + least((1 - v/t)*1.5, 1) + least(m*5, 1))/3 AS attendance_score FROM mu JOIN db ON k = panchayat)")


@query("k1_attendance_score", f"WITH {_K1} SELECT panchayat, round(attendance_score, 6) AS attendance_score FROM att")
def k1(t: Tables) -> DataFrame:
    r = risk.attendance_score(musters(t), ["panchayat"], days="person_days", verified="verified", category="material_type", day="paid_on", earthwork="R")
    return r.withColumn("attendance_score", rnd("attendance_score", 6))


def scored(t: Tables) -> DataFrame:
    """All panchayats with attendance, satellite, photo and payment scores."""
    units = roles.panchayats(t).select("panchayat", "block", "district", "state")
    att = risk.attendance_score(musters(t), ["panchayat"], days="person_days", verified="verified", category="material_type", day="paid_on", earthwork="R")
    pay = P.payment_score(work_costs(t), ["panchayat"], labour="labour", material="material", shell="shell", split="split")
    photo = photos.photo_score(pictures.issue_table(t), ["work_id"]).withColumnRenamed("work_id", "panchayat")
    verdicts = raster.work_verdict(rasters.measures(t), tolerance_pct=20.000001).join(t.orders.select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("panchayat")), "work_id")
    weak = F.when(F.col("confidence") < 0.02, 0.1).otherwise(0.9)
    sat = raster.satellite_score(verdicts.select("panchayat", "verification_status", weak.alias("confidence_score")), ["panchayat"])
    orders = t.orders.select(F.col("o_custkey").alias("panchayat"), "o_totalprice", "o_orderdate")
    exp = stats.expenditure_score(orders, ["panchayat"], "o_totalprice", "o_orderdate").select("panchayat", "expenditure_score")
    return risk.composite(units, "panchayat", [exp, att, sat, photo, pay])


_SCORED = (PANCHAYATS + ", " + _K1 + ", " + _WORK_COST + ", ws AS (SELECT *, CASE WHEN labour+material > 0 AND labour/(labour+material) < 0.6 THEN least((0.6 - labour/(labour+material))/0.6*2, 1) END AS v FROM wc), "
           "pay AS (SELECT panchayat, (coalesce(sum(v), 0) + least(count(*) FILTER (WHERE shell)*1.0::DOUBLE/count(*)*3, 1) + least(count(*) FILTER (WHERE split)*1.0::DOUBLE/count(*)*2.5, 1))/(count(v)+2) AS payment_score FROM ws GROUP BY 1), "
           + pictures.PHOTOS + ", pho AS (SELECT work_id AS panchayat, " + pictures.PHOTO_SCORE + " AS photo_score FROM photos GROUP BY 1), " + rasters._MEAS
           + ", sat AS (SELECT o_custkey AS panchayat, " + rasters.SATELLITE_SCORE + " AS satellite_score FROM vd JOIN orders ON work_id = o_orderkey GROUP BY 1), " + EXPENDITURE + ", ord AS (SELECT k AS panchayat, score AS expenditure_score FROM expenditure), "
           "sc AS (SELECT p.panchayat, block, district, state, coalesce(expenditure_score, 0) AS e, coalesce(attendance_score, 0) AS a, coalesce(satellite_score, 0) AS s, coalesce(photo_score, 0) AS f, coalesce(payment_score, 0) AS y, "
           "0.25*coalesce(expenditure_score, 0) + 0.25*coalesce(attendance_score, 0) + 0.20*coalesce(satellite_score, 0) + 0.15*coalesce(photo_score, 0) + 0.15*coalesce(payment_score, 0) AS c "
           "FROM panchayats p LEFT JOIN ord USING (panchayat) LEFT JOIN sat USING (panchayat) LEFT JOIN att USING (panchayat) LEFT JOIN pho USING (panchayat) LEFT JOIN pay USING (panchayat))")
_FLAGN = "(e >= 0.6)::INT + (a >= 0.6)::INT + (s >= 0.6)::INT + (f >= 0.6)::INT + (y >= 0.6)::INT"


@query("k2_composite_risk", f"WITH {_SCORED} SELECT panchayat, district, round(c, 6) AS composite_score, {_FLAGN} AS flags FROM sc")
def k2(t: Tables) -> DataFrame:
    return scored(t).select("panchayat", "district", rnd("composite_score", 6).alias("composite_score"), F.size("anomaly_flags").alias("flags"))


@query("k3_priority_queue", f"WITH {_SCORED} SELECT panchayat, round(c, 6) AS composite_score FROM sc WHERE c >= 0.3")
def k3_queue(t: Tables) -> DataFrame:
    return risk.priority_queue(scored(t), "panchayat", 0.3).select("panchayat", rnd("composite_score", 6).alias("composite_score"))


_TIERS = ", dm AS (SELECT district, max(c) AS m FROM sc GROUP BY 1)"


@query("a13_dashboard", f"WITH {_SCORED}{_TIERS} SELECT count(*) AS units, count(*) FILTER (WHERE c >= 0.55) AS queued, count(DISTINCT block) AS blocks, count(DISTINCT state) AS states, "
       "round(coalesce(sum(50*c*0.3) FILTER (WHERE c >= 0.5), 0)/100, 6) AS leakage_crore, (SELECT count(*) FROM dm WHERE m >= 0.75) AS high_risk_districts, "
       "(SELECT count(*) FROM dm WHERE m >= 0.5 AND m < 0.75) AS medium_risk_districts, (SELECT count(*) FROM dm WHERE m < 0.5) AS low_risk_districts FROM sc")
def a13(t: Tables) -> DataFrame:
    r = risk.dashboard(scored(t), district="district", block="block", state="state", queue_at=0.55)
    return r.withColumn("leakage_crore", rnd("leakage_crore", 6))


@query("a13_flag_counts", f"WITH {_SCORED} " + " UNION ALL ".join(
    f"SELECT '{n}' AS flag, count(*) AS count FROM sc WHERE {c} >= 0.6 HAVING count(*) > 0" for c, n in zip("easfy", risk.FLAG_NAMES.values())))
def a13_flags(t: Tables) -> DataFrame:
    return risk.flag_counts(scored(t))


@query("a14_max_rollup", f"WITH {_SCORED} SELECT district, round(max(c), 6) AS risk_score FROM sc GROUP BY 1")
def a14(t: Tables) -> DataFrame:
    return risk.roll_up_max(scored(t), "district").withColumn("risk_score", rnd("risk_score", 6))


@query("k4_investigation_routing", f"WITH {_SCORED} SELECT panchayat, CASE WHEN NOT (e >= 0.6 OR a >= 0.6 OR s >= 0.6 OR f >= 0.6 OR y >= 0.6) THEN 4 ELSE "
       "(s >= 0.6 OR e >= 0.6)::INT + (a >= 0.6)::INT + (y >= 0.6 OR e >= 0.6)::INT + (f >= 0.6)::INT END AS steps FROM sc")
def k4(t: Tables) -> DataFrame:
    return risk.investigations(scored(t), "panchayat").select("panchayat", F.size("steps").alias("steps"))


@query("k5_pilot_recommendation", f"WITH {ANOMALIES} SELECT district, count(*) FILTER (WHERE severity = 'critical') AS ghosts, CAST(sum(CAST(loss AS DECIMAL(14,2))) AS DOUBLE)*100 AS amount, "
       "count(*) FILTER (WHERE status = 'escalated') AS mismatches, count(*) AS findings, CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 10 OR CAST(sum(CAST(loss AS DECIMAL(14,2))) AS DOUBLE)*100 > 1000000 OR count(*) FILTER (WHERE status = 'escalated') > 2 "
       "THEN 'HIGH RISK' WHEN count(*) > 5 OR CAST(sum(CAST(loss AS DECIMAL(14,2))) AS DOUBLE)*100 > 500000 THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS recommendation FROM anomalies GROUP BY 1")
def k5(t: Tables) -> DataFrame:
    a = roles.anomalies(t).groupBy("district").agg(
        F.count_if(F.col("severity") == "critical").alias("ghosts"), (F.sum(F.col("loss").cast("decimal(14,2)")).cast("double") * 100).alias("amount"),
        F.count_if(F.col("status") == "escalated").alias("mismatches"), F.count(F.lit(1)).alias("findings"),
    )
    return risk.pilot_recommendation(a, ghosts="ghosts", amount="amount", mismatches="mismatches", findings="findings")


@query("k6_district_scan", f"WITH {_SCORED}, p AS (SELECT district, round(sum(labour + material), 2) AS suspicious FROM wc GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY c DESC, panchayat) AS rank FROM sc WHERE c >= 0.25) "
       "SELECT district, panchayat, CAST(rank AS INTEGER) AS rank, suspicious FROM r LEFT JOIN p USING (district) WHERE rank <= 10")
def k6(t: Tables) -> DataFrame:
    pay = work_costs(t).groupBy("district").agg(rnd(F.sum(F.col("labour") + F.col("material")), 2).alias("suspicious"))
    return risk.district_scan(scored(t), pay, "district", "panchayat", 0.25).select("district", "panchayat", "rank", "suspicious")


# -- evidence and reports -----------------------------------------------------------------

def evidence(t: Tables) -> DataFrame:
    return roles.anomalies(t).select(
        F.col("user_id").alias("case_id"), F.col("anomaly_id").alias("evidence_id"), F.col("anomaly_type").alias("evidence_type"), F.col("detected_at").alias("collected_at"), "confidence", F.col("loss").cast("decimal(14,2)").alias("amount"),
    )


_EVIDENCE = (pictures.PHOTOS + ", ev AS (SELECT 'satellite' AS evidence_type, o_custkey AS case_id, o_orderkey AS ref, o_orderdate AS seen, 0.9::DOUBLE AS confidence FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'muster', user_id, event_id, ts, 0.8 FROM events "
             "UNION ALL SELECT 'payment', o_custkey, l_orderkey*10 + l_linenumber, l_shipdate, 0.75 FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'photo', work_id, photo_id, ts, 0.85 FROM photos WHERE k % 7 = 0)")


def all_evidence(t: Tables) -> DataFrame:
    """Evidence of all four detectors with the case (a panchayat or worker id) that it belongs to."""
    def part(df: DataFrame, kind: str, case: str, ref: str, at: str, conf: float) -> DataFrame:
        return df.select(F.lit(kind).alias("evidence_type"), F.col(case).alias("case_id"), F.expr(ref).alias("ref"), F.col(at).cast("timestamp").alias("at"), F.lit(conf).alias("confidence"))

    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    photos_ = pictures.photo_table(t).filter("k % 7 = 0")
    return findings.union_all([
        part(t.orders.filter("o_orderstatus = 'F'"), "satellite", "o_custkey", "o_orderkey", "o_orderdate", 0.9), part(t.events, "muster", "user_id", "event_id", "ts", 0.8),
        part(lines, "payment", "o_custkey", "l_orderkey * 10 + l_linenumber", "l_shipdate", 0.75), part(photos_, "photo", "work_id", "photo_id", "capture_ts", 0.85),
    ])


@query("e1_evidence_union", f"WITH {_EVIDENCE} SELECT evidence_type, case_id, ref, confidence FROM ev")
def e1(t: Tables) -> DataFrame:
    return all_evidence(t).select("evidence_type", "case_id", "ref", "confidence")


@query("e1_latest_evidence", f"WITH {_EVIDENCE} SELECT case_id, evidence_type, arg_max(ref, (seen, ref)) AS ref, max(confidence) AS confidence FROM ev WHERE case_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1, 2")
def e1_latest(t: Tables) -> DataFrame:
    open_cases = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("case_id"))
    members = all_evidence(t).join(open_cases, "case_id", "left_semi")
    return latest_per_key(members, ["case_id", "evidence_type"], "at", "ref").select("case_id", "evidence_type", "ref", "confidence")


@query("e2_evidence_chain", f"WITH {ANOMALIES}, p AS (SELECT user_id, anomaly_type, arg_min(anomaly_id, (-confidence, detected_at, anomaly_id)) AS i FROM anomalies GROUP BY 1, 2), "
       "q AS (SELECT user_id, count(*) AS n, string_agg(anomaly_type || ':' || i, ',' ORDER BY anomaly_type) AS primaries FROM p GROUP BY 1), a AS (SELECT user_id, count(*) AS items, round(avg(confidence), 9) AS m FROM anomalies GROUP BY 1) "
       "SELECT user_id AS case_id, items, m AS mean_confidence, n AS evidence_types, primaries, CASE WHEN n >= 3 AND m >= 0.7 THEN 'strong' WHEN n >= 2 AND m >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength FROM a JOIN q USING (user_id)")
def e2(t: Tables) -> DataFrame:
    r = reports.evidence_chain(evidence(t))
    text = F.array_join(F.transform("primaries", lambda p: F.concat_ws(":", p["evidence_type"], p["evidence_id"].cast("string"))), ",")
    return r.select("case_id", "items", "mean_confidence", "evidence_types", text.alias("primaries"), "strength")


def cases(t: Tables) -> DataFrame:
    kinds = {"error": "satellite_mismatch", "click": "ghost_worker", "view": "payment_anomaly", "signup": "photo_anomaly"}
    expr = F.lit("other")
    for k, v in kinds.items():
        expr = F.when(F.col("anomaly_type") == k, v).otherwise(expr)
    a = roles.anomalies(t).withColumn("kind", expr).withColumn("loss", F.col("loss").cast("decimal(14,2)"))
    return reports.case_files(a, "district", kind="kind", loss="loss", worker="user_id")


@query("e3_case_files", f"WITH {ANOMALIES} SELECT district, count(*) AS anomalies, CAST(sum(CAST(loss AS DECIMAL(14,2))) AS DOUBLE) AS estimated_loss, count(DISTINCT user_id) AS affected_workers, "
       "CAST(count(DISTINCT CASE anomaly_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 END) + 2 AS INTEGER) AS actions FROM anomalies GROUP BY 1")
def e3(t: Tables) -> DataFrame:
    return cases(t).select("district", "anomalies", F.col("estimated_loss").cast("double").alias("estimated_loss"), "affected_workers", F.size("actions").alias("actions"))


@query("e4_observations", f"WITH {ANOMALIES}, k AS (SELECT DISTINCT district, CASE anomaly_type WHEN 'error' THEN 'satellite_mismatch' WHEN 'click' THEN 'ghost_worker' WHEN 'view' THEN 'payment_anomaly' WHEN 'signup' THEN 'photo_anomaly' ELSE 'other' END AS kind FROM anomalies), "
       "c AS (SELECT district, string_agg(kind, ', ' ORDER BY kind) AS condition, coalesce(string_agg(CASE kind WHEN 'satellite_mismatch' THEN 'Section 17(1)' WHEN 'ghost_worker' THEN 'Section 25, Para 19.4' WHEN 'payment_anomaly' THEN 'Para 7.7' END, ' | ' ORDER BY kind), 'general') AS criteria FROM k GROUP BY 1) "
       "SELECT district, '4.2.' || right(CAST(district AS VARCHAR), 3) AS para, criteria, condition, 'weak_supervision, no_live_monitoring, weak_biometric_checks, possible_collusion' AS cause, CAST(sum(CAST(loss AS DECIMAL(14,2))) AS DOUBLE) AS effect, count(DISTINCT user_id) AS affected_workers, "
       "'recover_irregular_payments, fix_accountability, geotag_monitoring, biometric_attendance' AS recommendation FROM anomalies JOIN c USING (district) GROUP BY 1, 2, 3, 4")
def e4(t: Tables) -> DataFrame:
    return reports.observations(cases(t), "district").withColumn("effect", F.col("effect").cast("double"))


@query("e5_district_briefing", f"WITH {ANOMALIES}, s AS (SELECT district, count(*) FILTER (WHERE status IN ('open','under_investigation')) AS open_cases, count(DISTINCT user_id) AS flagged_works FROM anomalies GROUP BY 1), "
       f"k AS (SELECT district, string_agg(anomaly_type || ':' || count, ',' ORDER BY rank) AS top_kinds FROM ({REGISTRY['a9_top_types'].oracle}) GROUP BY 1), "
       f"b AS (SELECT c_nationkey AS district, count(*) AS blocks, count(*) FILTER (WHERE risk_level = 'high') AS high_risk_blocks, arg_max(block_id, (risk_score, -block_id)) FILTER (WHERE risk_score IS NOT NULL) AS worst_block FROM ({REGISTRY['j10_blocks_with_risk'].oracle}) JOIN customer ON block_id = c_custkey GROUP BY 1) "
       "SELECT district, open_cases, flagged_works, top_kinds, blocks, high_risk_blocks, worst_block, concat_ws(',', CASE WHEN open_cases > 10 THEN 'review_meeting' END, CASE WHEN flagged_works > 50 THEN 'deploy_verification_teams' END, 'geotag_all_new_works', 'update_schedule_of_rates') AS actions, "
       "concat_ws(',', CASE WHEN open_cases > 0 THEN 'open_cases:' || open_cases END, 'most_frequent:' || string_split(top_kinds, ',')[1], CASE WHEN high_risk_blocks > 0 THEN 'high_risk_blocks:' || high_risk_blocks END) AS key_findings FROM s LEFT JOIN k USING (district) LEFT JOIN b USING (district)")
def e5(t: Tables) -> DataFrame:
    c = roles.anomalies(t).withColumn("ids", F.array("user_id"))
    s = rollup.case_stats(c, ["district"], status="status", created="detected_at", start="2024-01-15", works="ids", loss="loss")
    blocks = joins.j10(t).join(t.customer.select(F.col("c_custkey").alias("block_id"), F.col("c_nationkey").alias("district")), "block_id")
    r = reports.briefing(s, relational.a9(t), blocks, "district", "anomaly_type")
    texts = {c: F.array_join(c, ",") for c in ("top_kinds", "actions", "key_findings")}
    return r.withColumns(texts).select("district", "open_cases", "flagged_works", "top_kinds", "blocks", "high_risk_blocks", "worst_block", "actions", "key_findings")


@query("e6_weekly_summary", f"WITH {ANOMALIES}, w AS (SELECT district, CAST(date_trunc('week', detected_at) AS DATE) AS week, count(*) AS new_anomalies, count(*) FILTER (WHERE status = 'closed' AND updated_at >= date_trunc('week', detected_at)) AS r, "
       "count(*) FILTER (WHERE status = 'escalated' AND updated_at >= date_trunc('week', detected_at)) AS e FROM anomalies GROUP BY 1, 2) SELECT district, week, new_anomalies, CAST((new_anomalies > r)::INT + (e > 0)::INT AS INTEGER) AS highlights FROM w")
def e6(t: Tables) -> DataFrame:
    w = rollup.weekly_stats(roles.anomalies(t), ["district"], detected="detected_at", updated="updated_at", status="status", loss="loss")
    return reports.weekly_highlights(w).select("district", "week", "new_anomalies", F.size("highlights").alias("highlights"))


def checks(t: Tables) -> DataFrame:
    money = F.col("amount").cast("decimal(14,2)")
    return roles.payments(t).select(
        "district", "work_id", money.cast("double").alias("reported"), (F.col("amount") * (1 - F.col("quantity") / 100)).alias("detected"),
        F.when(F.col("quantity") > 30, "DISCREPANT").when(F.col("quantity") > 10, "VERIFIED").otherwise("UNVERIFIABLE").alias("status"),
    )


@query("e7_district_report", f"WITH {PAYMENTS}, s AS (SELECT district, count(*) AS works, count(*) FILTER (WHERE quantity > 10 AND quantity <= 30) AS verified, count(*) FILTER (WHERE quantity > 30) AS flagged, sum(amount) AS x, "
       "sum(CASE WHEN quantity > 30 THEN abs(amount - amount*(1-quantity/100)) ELSE 0 END) AS l FROM payments GROUP BY 1) SELECT district, works, verified, flagged, round(100.0::DOUBLE*verified/works, 6) AS verified_pct, round(100*l/x, 6) AS leakage_pct, "
       "CASE WHEN 100*l/x > 20 OR flagged > works*0.3 THEN 'CRITICAL' WHEN 100*l/x > 10 THEN 'HIGH' WHEN 100*l/x > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s")
def e7(t: Tables) -> DataFrame:
    r = reports.district_report(checks(t), ["district"], reported="reported", detected="detected", status="status")
    return r.select("district", "works", "verified", "flagged", rnd("verified_pct", 6).alias("verified_pct"), rnd("leakage_pct", 6).alias("leakage_pct"), "risk_level")


@query("e7_top_anomalies", f"WITH {ANOMALIES}, r AS (SELECT district, anomaly_id, severity, loss, row_number() OVER (PARTITION BY district ORDER BY coalesce(list_position(['critical', 'high', 'medium', 'low'], severity), 5), loss DESC, anomaly_id) AS rank FROM anomalies) SELECT district, CAST(rank AS INTEGER) AS rank, anomaly_id, severity, loss FROM r WHERE rank <= 20")
def e7_top(t: Tables) -> DataFrame:
    return reports.top_findings(roles.anomalies(t), ["district"], "severity", "loss", "anomaly_id").select("district", "rank", "anomaly_id", "severity", "loss")


@query("e8_numbered_paragraphs", f"WITH {WORKS}, r AS (SELECT district, work_id, amount, row_number() OVER (PARTITION BY district ORDER BY amount DESC, work_id) AS n FROM works WHERE amount > 400000) SELECT district, work_id, amount, CAST(n AS INTEGER) AS para_no FROM r WHERE n <= 10")
def e8(t: Tables) -> DataFrame:
    w = roles.works(t).filter("amount > 400000").select("district", "work_id", "amount")
    return reports.numbered_paragraphs(w, ["district"], "amount", "work_id")


@query("e8_audit_paragraphs", f"WITH {PAYMENTS}, {ANOMALIES}, s AS (SELECT district, count(*) FILTER (WHERE quantity > 30) AS flagged, sum(CASE WHEN quantity > 30 THEN abs(amount - amount*(1-quantity/100)) ELSE 0 END) AS l FROM payments GROUP BY 1), "
       "r AS (SELECT district, anomaly_id, severity, loss, row_number() OVER (PARTITION BY district ORDER BY coalesce(list_position(['critical', 'high', 'medium', 'low'], severity), 5), loss DESC, anomaly_id) AS rank FROM anomalies), n AS (SELECT district, count(*) AS n FROM r WHERE rank <= 10 GROUP BY 1) "
       "SELECT district, CAST(1 AS INTEGER) AS para_no, 'executive_observation' AS heading, CAST(NULL AS VARCHAR) AS ref, round(l, 2) AS amount FROM s UNION ALL SELECT district, CAST(rank + 1 AS INTEGER), 'anomaly_' || severity, CAST(anomaly_id AS VARCHAR), round(loss, 2) FROM r WHERE rank <= 10 "
       "UNION ALL SELECT district, CAST(coalesce(n, 0) + 2 AS INTEGER), 'satellite_discrepancies', CAST(flagged AS VARCHAR), NULL FROM s LEFT JOIN n USING (district) WHERE flagged > 0")
def e8_paragraphs(t: Tables) -> DataFrame:
    summary = reports.district_report(checks(t), ["district"], reported="reported", detected="detected", status="status")
    ranked = reports.top_findings(roles.anomalies(t), ["district"], "severity", "loss", "anomaly_id")
    return reports.paragraphs(summary, ranked, ["district"], severity="severity", amount="loss", ref="anomaly_id").withColumn("amount", rnd("amount", 2))


@query("e9_case_financials", f"WITH {ANOMALIES}, l AS (SELECT user_id, anomaly_type, arg_max(loss, (detected_at, anomaly_id)) AS amount FROM anomalies GROUP BY 1, 2) SELECT user_id AS case_id, anomaly_type AS evidence_type, amount, round(sum(amount) OVER (PARTITION BY user_id), 2) AS case_total FROM l")
def e9(t: Tables) -> DataFrame:
    r = reports.case_financials(evidence(t), "case_id", "amount")
    return r.select("case_id", "evidence_type", F.col("amount").cast("double").alias("amount"), rnd("case_total", 2).alias("case_total"))


@query("e10_block_progress", f"WITH {WORKS} SELECT district, block, CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS works, count(*) FILTER (WHERE status = 'F') AS completed, count(*) FILTER (WHERE status = 'P') AS pending FROM works GROUP BY 1, 2, 3")
def e10(t: Tables) -> DataFrame:
    w = roles.works(t).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    return rollup.counted(w, ["district", "block", "week"], {"works": F.lit(True), "completed": F.col("status") == "F", "pending": F.col("status") == "P"})


@query("e11_leakage_estimate", f"WITH {PAYMENTS}, s AS (SELECT district, count(*) AS n, sum(greatest(amount - amount*(1-quantity/100), 0)) AS g, sum(amount) AS r, stddev_samp(greatest(amount - amount*(1-quantity/100), 0)) AS sd FROM payments GROUP BY 1), "
       "e AS (SELECT *, g/r AS q, g/r*1e9 AS est, 1.96*sd/sqrt(n)*10000 AS h FROM s) SELECT district, n, round(q, 8) AS leakage_ratio, round(est/1e6, 6) AS estimate_m, round(greatest(est - h, 0)/1e6, 6) AS low_m, round((est + h)/1e6, 6) AS high_m FROM e")
def e11(t: Tables) -> DataFrame:
    r = reports.leakage_estimate(checks(t), ["district"], reported="reported", detected="detected", population=F.lit(10_000), total=F.lit(1e9))
    return r.select("district", "n", rnd("leakage_ratio", 8).alias("leakage_ratio"), *[rnd(F.col(c) / 1e6, 6).alias(f"{n}_m") for c, n in (("estimate", "estimate"), ("low", "low"), ("high", "high"))])


@query("e12_finding_records", f"WITH {ANOMALIES} SELECT sha256('spike|' || anomaly_id || '|' || severity) AS finding_id, 'spike' AS category, severity, loss AS amount, confidence FROM anomalies WHERE severity = 'critical'")
def e12(t: Tables) -> DataFrame:
    a = roles.anomalies(t).filter("severity = 'critical'")
    r = findings.findings(a, "spike", severity=F.col("severity"), entities=["anomaly_id"], evidence=["severity"], amount=F.col("loss"), confidence=F.col("confidence"))
    return r.select("finding_id", "category", "severity", "amount", "confidence")


# -- contracts ------------------------------------------------------------------------------

@query("c1_monthly_trend", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS total, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS amount, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def c1(t: Tables) -> DataFrame:
    o = t.orders.withColumn("amt", F.col("o_totalprice").cast("decimal(14,2)"))
    return reports.monthly_trend(o, "o_orderdate", "o_orderstatus", ["F", "O", "P"], "amt").withColumn("amount", F.col("amount").cast("double"))


_LA, _LO = spot_sql("o_orderkey", 7919, 104729)


@query("c2_hotspots", f"WITH p AS (SELECT {_LA} AS la, {_LO} AS lo, o_orderpriority AS k, o_custkey FROM orders), g AS (SELECT *, CAST(floor(la) AS BIGINT) AS cell_y, CAST(floor(lo) AS BIGINT) AS cell_x FROM p), c AS (SELECT cell_y, cell_x, count(*) AS count, avg(la) AS cla, avg(lo) AS clo, count(DISTINCT o_custkey) AS places FROM g GROUP BY 1, 2 HAVING count(*) >= 10), "
       "d AS (SELECT cell_y, cell_x, arg_min(k, (-n, k)) AS dominant FROM (SELECT cell_y, cell_x, k, count(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2), "
       "h AS (SELECT g.cell_y, g.cell_x, max(power(sin(radians(cla-la)/2),2) + cos(radians(la))*cos(radians(cla))*power(sin(radians(clo-lo)/2),2)) AS hv FROM g JOIN c ON g.cell_y = c.cell_y AND g.cell_x = c.cell_x GROUP BY 1, 2) "
       "SELECT cell_y, cell_x, count, places, dominant, round(2*6371.0*atan2(sqrt(hv), sqrt(1-hv)), 3) AS radius_km FROM c JOIN d USING (cell_y, cell_x) JOIN h USING (cell_y, cell_x)")
def c2(t: Tables) -> DataFrame:
    la, lo = spot("o_orderkey", 7919, 104729)
    p = t.orders.select(la.alias("lat"), lo.alias("lon"), "o_orderpriority", "o_custkey")
    r = reports.hotspots(p, "lat", "lon", "o_orderpriority", "o_custkey", 1.0, 10)
    return r.select("cell_y", "cell_x", "count", "places", "dominant", rnd("radius_km", 3).alias("radius_km"))


@query("c3_repeated_payments", "SELECT l_suppkey, l_quantity, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS payments FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1")
def c3(t: Tables) -> DataFrame:
    li = t.lineitem.withColumn("month", F.trunc(F.to_date("l_shipdate"), "month"))
    return reports.repeated_payments(li, ["l_suppkey", "month"], "l_quantity")


@query("c4_account_runs", "WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, l_partkey AS n FROM lineitem), r AS (SELECT day, n, n - row_number() OVER (PARTITION BY day ORDER BY n) AS g FROM d) "
       "SELECT day, min(n) AS first_number, max(n) AS last_number, count(*) AS accounts FROM r GROUP BY day, g HAVING count(*) >= 2")
def c4(t: Tables) -> DataFrame:
    li = t.lineitem.select(F.to_date("l_shipdate").alias("day"), "l_partkey")
    return reports.account_runs(li, ["day"], "l_partkey", 2)


@query("c5_shared_accounts", "SELECT l_suppkey, count(DISTINCT l_partkey) AS holders FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def c5(t: Tables) -> DataFrame:
    return reports.shared_accounts(t.lineitem, "l_suppkey", "l_partkey")


@query("c6_against_peers", "WITH m AS (SELECT l_returnflag, avg(l_extendedprice/l_quantity) AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, l_partkey, l_suppkey, round(l_extendedprice/l_quantity/p, 6) AS relative FROM lineitem JOIN m USING (l_returnflag)")
def c6(t: Tables) -> DataFrame:
    r = reports.against_peers(t.lineitem, "l_returnflag", "l_extendedprice", "l_quantity")
    return r.select("l_orderkey", "l_partkey", "l_suppkey", rnd("relative", 6).alias("relative"))


@query("c7_implausible_workers", "SELECT p_partkey, p_size, 'age' AS reason FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, p_size, 'deceased' FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0 AND l_discount = 0)")
def c7(t: Tables) -> DataFrame:
    dead = t.lineitem.filter("l_tax = 0 and l_discount = 0").select(F.col("l_partkey").alias("p_partkey"))
    return reports.implausible_workers(t.part.select("p_partkey", "p_size"), dead, "p_partkey", "p_size", 45)


@query("c8_leakage_by_type", "SELECT l_returnflag, round(sum(l_extendedprice*l_discount), 2) AS leakage FROM lineitem GROUP BY 1")
def c8(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(rnd(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("leakage"))


@query("c8_top_panchayats", f"WITH {_SCORED}, lk AS (SELECT o_custkey AS panchayat, sum(l_extendedprice*l_discount) AS leakage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) "
       "SELECT panchayat, round(leakage, 2) AS leakage, round(c*100, 4) AS risk_score FROM lk JOIN sc USING (panchayat) ORDER BY leakage DESC, panchayat LIMIT 10")
def c8_top(t: Tables) -> DataFrame:
    lost = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * F.col("l_discount")).alias("lost"))
    lost = spread(lost, "o_orderkey").join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    lost = lost.groupBy(F.col("o_custkey").alias("panchayat")).agg(F.sum("lost").alias("leakage"))
    top = lost.join(scored(t).select("panchayat", "composite_score"), "panchayat").orderBy(F.col("leakage").desc(), "panchayat").limit(10)
    return top.select("panchayat", rnd("leakage", 2).alias("leakage"), rnd(F.col("composite_score") * 100, 4).alias("risk_score"))


@query("c9_status_transitions", "WITH c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'flagged' WHEN 'O' THEN 'investigating' ELSE 'confirmed' END AS s, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'investigating' WHEN o_orderpriority = '3-MEDIUM' THEN 'confirmed' END AS u FROM orders), "
       "x AS (SELECT *, coalesce((s = 'flagged' AND u = 'investigating') OR (s = 'investigating' AND u IN ('confirmed', 'dismissed')), false) AS ok FROM c) SELECT o_orderkey, CASE WHEN ok THEN u ELSE s END AS status, CASE WHEN u IS NOT NULL THEN ok END AS accepted FROM x")
def c9(t: Tables) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "flagged").when(F.col("o_orderstatus") == "O", "investigating").otherwise("confirmed")
    u = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "investigating").when(F.col("o_orderpriority") == "3-MEDIUM", "confirmed")
    upd = t.orders.select("o_orderkey", u.alias("status")).filter("status is not null")
    return reports.transition(t.orders.select("o_orderkey", s.alias("status")), upd, "o_orderkey")


@query("c10_scoped_statistics", f"WITH {WORKS} SELECT state, district, count(*) AS works, count(*) FILTER (WHERE status = 'F') AS completed FROM works GROUP BY ROLLUP (state, district)")
def c10(t: Tables) -> DataFrame:
    return roles.works(t).rollup("state", "district").agg(F.count(F.lit(1)).alias("works"), F.count_if(F.col("status") == "F").alias("completed"))


@query("c11_risk_trend", "WITH w AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY week) AS previous FROM w) "
       "SELECT user_id, week, CASE WHEN (n-previous)*100.0/previous > 10 THEN 'increasing' WHEN (n-previous)*100.0/previous < -10 THEN 'decreasing' ELSE 'stable' END AS trend FROM l WHERE previous IS NOT NULL")
def c11(t: Tables) -> DataFrame:
    w = t.events.groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return period_change(w, ["user_id"], "week", "n", 10.0).select("user_id", "week", "trend")
