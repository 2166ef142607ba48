"""Attendance and payment detectors on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import attendance, payments, similarity
from ..session import spread
from . import joins as J
from . import roles
from .base import Tables, query, rnd
from .roles import PAYMENTS
from .scalars import HOLIDAYS, REASON, spot, spot_sql


def attendance_rows(t: Tables) -> DataFrame:
    return t.events.select(
        F.trunc(F.to_date("ts"), "month").alias("work_id"), F.col("user_id").alias("worker_id"), F.to_date("ts").alias("day")
    )


_ATT = "SELECT CAST(date_trunc('month', ts) AS DATE) AS s, user_id AS m, CAST(ts AS DATE) AS i FROM events"


@query("m1_clone_pairs", J._pairs_sql(_ATT, 0.9, 1).replace("s AS scope", "s AS work_id"))
def m1(t: Tables) -> DataFrame:
    r = similarity.jaccard_pairs(attendance_rows(t), ["work_id"], "worker_id", "day", 0.9)
    return r.withColumn("similarity", rnd("similarity", 8))


# a sequential pass: workers in order of first day and id, each free one gathers its later free partners
_PASS = ("WITH RECURSIVE x AS (SELECT DISTINCT s, m, i FROM (" + _ATT + ")), f AS (SELECT s, m, min(i) AS f, list(i) AS l, count(*) AS n FROM x GROUP BY 1, 2), "
         "o AS (SELECT s, m, l, n, row_number() OVER (PARTITION BY s ORDER BY f, m) AS k FROM f), "
         "p AS (SELECT s, ka, kb FROM (SELECT a.s, a.k AS ka, b.k AS kb, a.n + b.n AS nn, len(list_intersect(a.l, b.l)) AS o FROM o a JOIN o b ON a.s = b.s AND a.k < b.k) WHERE o >= 1 AND o >= 0.9*(nn - o) - 1e-12), "
         "j AS (SELECT o.s, o.k, coalesce(list(kb ORDER BY kb) FILTER (WHERE kb IS NOT NULL), []) AS nb FROM o LEFT JOIN p ON p.s = o.s AND ka = o.k GROUP BY 1, 2), "
         "r(s, k, taken, mem) AS (SELECT DISTINCT s, CAST(0 AS BIGINT), []::BIGINT[], []::BIGINT[] FROM o UNION ALL "
         "SELECT s, k, list_concat(taken, mem), mem FROM (SELECT r.s, j.k, r.taken, CASE WHEN list_contains(r.taken, j.k) THEN [] ELSE list_filter(j.nb, lambda z: NOT list_contains(r.taken, z)) END AS mem FROM r JOIN j ON j.s = r.s AND j.k = r.k + 1)), "
         "g AS (SELECT r.s, o.m AS leader, len(mem) + 1 AS workers, unnest(list_prepend(r.k, mem)) AS k FROM r JOIN o ON o.s = r.s AND o.k = r.k WHERE len(mem) > 0)")


@query("m2_clone_groups", f"{_PASS}, dy AS (SELECT g.s, leader, workers, i, count(*) AS c FROM g JOIN o ON o.s = g.s AND o.k = g.k JOIN x ON x.s = o.s AND x.m = o.m GROUP BY 1, 2, 3, 4), "
       "ag AS (SELECT s, leader, workers, count(*) FILTER (WHERE c = workers) AS al, count(*) AS anyone FROM dy GROUP BY 1, 2, 3), td AS (SELECT s, count(DISTINCT i) AS total_days FROM x GROUP BY 1) "
       "SELECT s AS work_id, leader, workers, total_days, al + total_days - anyone AS matching_days, round((al + total_days - anyone)*1.0::DOUBLE/total_days, 6) AS overlap_pct, (al + total_days - anyone)*(workers - 1) AS fake_person_days FROM ag JOIN td USING (s)")
def m2(t: Tables) -> DataFrame:
    r = attendance.clone_groups(attendance_rows(t), "work_id", "worker_id", "day", 0.9)
    return r.withColumn("overlap_pct", rnd("overlap_pct", 6))


@query("m2_clone_members", f"{_PASS} SELECT g.s AS work_id, leader, o.m AS worker_id FROM g JOIN o ON o.s = g.s AND o.k = g.k")
def m2_members(t: Tables) -> DataFrame:
    return attendance.clone_members(attendance_rows(t), "work_id", "worker_id", "day", 0.9)


@query("st11_attendance_correlation", """
    WITH x AS (SELECT DISTINCT user_id AS m, CAST(ts AS DATE) AS i FROM events), nn AS (SELECT count(DISTINCT i)::DOUBLE AS n FROM x),
    l AS (SELECT m, list_sort(list(i)) AS l, count(*)::DOUBLE AS c FROM x GROUP BY 1), f AS (SELECT l, c, min(m) AS rep, count(*) AS members FROM l GROUP BY 1, 2),
    p AS (SELECT a.rep AS a, b.rep AS b, a.c AS x, b.c AS y, len(list_intersect(a.l, b.l))::DOUBLE AS o, a.members AS members_a, b.members AS members_b FROM f a JOIN f b ON a.rep < b.rep)
    SELECT a, b, CAST(o AS BIGINT) AS overlap, round((n*o - x*y)/sqrt(x*(n-x)*y*(n-y)), 8) AS correlation, members_a, members_b FROM p, nn
    WHERE x < n AND y < n AND (n*o - x*y)/sqrt(x*(n-x)*y*(n-y)) >= 0.8 - 1e-12
    """)
def st11(t: Tables) -> DataFrame:
    pairs, _ = similarity.correlated_pairs(attendance_rows(t), "worker_id", "day", 0.8)
    return pairs.select("a", "b", "overlap", rnd("similarity", 8).alias("correlation"), "members_a", "members_b")


_HIGH = "hw AS (SELECT o_custkey, count(*) AS c, count(*) FILTER (WHERE o_totalprice > 60000) AS h FROM orders GROUP BY 1)"
_SIGNS = [
    ("total_person_days > 0 AND biometric_auth_count = 0", 0.9),
    ("NOT (total_person_days > 0 AND biometric_auth_count = 0) AND total_person_days > 20 AND biometric_auth_count < 3", 0.7),
    ("coalesce(c >= 2 AND h = c, false)", 0.6),
    ("NOT has_dbt_payment AND total_wages > 0", 0.5),
    ("coalesce(first_work_date - registration_date < 2 AND total_person_days > 30, false)", 0.5),
    ("multi", 0.8),
    ("seqn", 0.7),
]
_N = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in _SIGNS)
_S = " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, w in _SIGNS)


@query("m3_ghost_workers", f"WITH {J.PROFILES}, {_HIGH}, g AS (SELECT *, {_N} AS n, {_S} AS w FROM prof LEFT JOIN hw ON o_custkey = worker_id) "
       "SELECT worker_id, panchayat_id, CAST(n AS INTEGER) AS signs, round(w/n, 6) AS confidence, CASE WHEN w/n > 0.8 THEN 'critical' ELSE 'high' END AS severity "
       "FROM g WHERE n >= 2 OR (n = 1 AND w >= 0.8)")
def m3(t: Tables) -> DataFrame:
    return ghosts(t).select("worker_id", "panchayat_id", F.size("indicators").alias("signs"), rnd("confidence", 6).alias("confidence"), "severity")


def ghosts(t: Tables) -> DataFrame:
    high = attendance.high_works_only(
        J.worker_tables(t)["musters"], t.orders.select(F.col("o_orderkey").alias("work_id"), "o_totalprice"), "o_totalprice", 60_000
    )
    return attendance.ghost_workers(J.profiles(t).join(high, "worker_id", "left"))


_LA, _LO = spot_sql("l_suppkey", 7919, 104729)


@query("m4_multi_site_days", f"""
    WITH x AS (SELECT DISTINCT l_partkey AS worker_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_suppkey AS site, {_LA} AS la, {_LO} AS lo FROM lineitem),
    s AS (SELECT worker_id, day, count(DISTINCT site) AS sites FROM x GROUP BY 1, 2 HAVING count(DISTINCT site) > 1),
    p AS (SELECT a.worker_id, a.day, power(sin(radians(b.la-a.la)/2),2) + cos(radians(a.la))*cos(radians(b.la))*power(sin(radians(b.lo-a.lo)/2),2) AS hv
          FROM x a JOIN x b ON a.worker_id = b.worker_id AND a.day = b.day AND a.site < b.site),
    d AS (SELECT worker_id, day, round(max(2*6371.0*atan2(sqrt(hv), sqrt(1-hv))), 1) AS distance_km FROM p GROUP BY 1, 2)
    SELECT worker_id, day, sites, distance_km, CASE WHEN distance_km > 50 THEN 'critical' WHEN distance_km > 10 THEN 'high' ELSE 'medium' END AS severity
    FROM s JOIN d USING (worker_id, day)
    """)
def m4(t: Tables) -> DataFrame:
    la, lo = spot("l_suppkey", 7919, 104729)
    rows = t.lineitem.select(
        F.col("l_partkey").alias("worker_id"), F.trunc(F.to_date("l_shipdate"), "month").alias("day"), F.col("l_suppkey").alias("site"),
        la.alias("lat"), lo.alias("lon"),
    )
    return attendance.multi_site_days(rows, "worker_id", "day", "site", "lat", "lon").drop("confidence")


@query("m5_monsoon_earthwork", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, month(l_shipdate)::INTEGER AS month, 'high' AS severity FROM lineitem "
       "WHERE l_returnflag = 'R' AND month(l_shipdate) IN (6,7,8,9) AND l_quantity > 5")
def m5(t: Tables) -> DataFrame:
    r = attendance.monsoon_earthwork(t.lineitem, "l_shipdate", "l_quantity", "l_returnflag", earthwork="R")
    return r.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "month", "severity")


@query("m6_wage_mismatches", f"WITH {J.WAGES}, d AS (SELECT *, abs(amount - quantity*wage_rate)/(quantity*wage_rate)*100 AS p FROM wr) "
       "SELECT worker_id, work_id, account, round(p, 5) AS deviation_pct, CASE WHEN p > 20 THEN 'high' ELSE 'medium' END AS severity, round(least(p/50, 1), 6) AS confidence FROM d WHERE p > 5")
def m6(t: Tables) -> DataFrame:
    r = attendance.wage_mismatches(J.wage_records(t), "person_days", "wage_rate", "amount_paid")
    return r.select("worker_id", "work_id", "account", rnd("deviation_pct", 5).alias("deviation_pct"), "severity", rnd("confidence", 6).alias("confidence"))


@query("m7_suspicious_dates", f"""
    WITH {HOLIDAYS}, x AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), r AS (SELECT user_id, day, {REASON} AS reason FROM x LEFT JOIN hol ON month(day) = m AND day(day) = d),
    f AS (SELECT user_id, day, CASE WHEN reason = 'Sunday' THEN 'weekend_attendance' WHEN reason LIKE '%Saturday' THEN 'non_working_saturday_attendance' ELSE 'holiday_attendance' END AS ft FROM r WHERE reason IS NOT NULL
      UNION ALL SELECT user_id, day, 'future_dated_attendance' FROM x WHERE day > DATE '2024-01-28'
      UNION ALL SELECT user_id, day, 'out_of_range_attendance' FROM x WHERE day < DATE '2024-01-03' OR day > DATE '2024-01-29'),
    i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g FROM x),
    u AS (SELECT user_id, ft AS finding_type, count(*) AS dates, min(day) AS first_date, max(day) AS last_date FROM f GROUP BY 1, 2
      UNION ALL SELECT user_id, 'impossible_attendance_streak', count(*), min(day), max(day) FROM i GROUP BY user_id, g HAVING count(*) > 14)
    SELECT *, CASE WHEN finding_type IN ('impossible_attendance_streak', 'future_dated_attendance') THEN 'critical' WHEN finding_type = 'non_working_saturday_attendance' THEN 'medium' ELSE 'high' END AS severity FROM u
    """)
def m7(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), F.lit("2024-01-03").cast("date").alias("lo"), F.lit("2024-01-29").cast("date").alias("hi"))
    return attendance.suspicious_dates(rows, ["user_id"], "day", as_of="2024-01-28", start="lo", end="hi")


@query("d1_shell_accounts", f"WITH {PAYMENTS}, a AS (SELECT district, account, count(DISTINCT panchayat) AS panchayats, count(DISTINCT work_id) AS works, count(DISTINCT worker_id) AS workers, "
       "CAST(sum(CAST(amount AS DECIMAL(14,2))) AS DOUBLE) AS total_amount, count(*) AS transactions FROM payments GROUP BY 1, 2) "
       "SELECT *, round(least(panchayats/10.0::DOUBLE, 1), 6) AS confidence FROM a WHERE panchayats >= 3")
def d1(t: Tables) -> DataFrame:
    p = roles.payments(t).withColumn("amount", F.col("amount").cast("decimal(14,2)"))
    r = payments.shell_accounts(p, ["district", "account"], panchayat="panchayat", work="work_id", worker="worker_id", amount="amount")
    return r.withColumns({"total_amount": F.col("total_amount").cast("double"), "confidence": rnd("confidence", 6)})


_SPLITS = ("sp AS (SELECT l_partkey AS account, l_shipdate AS d, l_orderkey*100000 + l_suppkey*10 + l_linenumber AS fto, CAST(l_extendedprice AS DECIMAL(14,2)) AS amt FROM lineitem), "
           "sw AS (SELECT a.account, a.fto, count(*) AS window_count, sum(b.amt) AS tot, max(b.amt) AS mx FROM sp a JOIN sp b ON a.account = b.account "
           "AND (b.d > a.d OR (b.d = a.d AND b.fto >= a.fto)) AND b.d < a.d + INTERVAL 31 DAY GROUP BY 1, 2)")


def split_rows(t: Tables, works: DataFrame | None = None) -> DataFrame:
    """Bursts of small payments; with ``works`` (work_id, district) the district of each."""
    p = t.lineitem.select(
        F.col("l_partkey").alias("account"), F.col("l_shipdate").alias("paid_at"),
        (F.col("l_orderkey") * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("fto"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"), F.col("l_orderkey").alias("work_id"),
    )
    r = payments.split_payments(p, ["account"], ts="paid_at", fto="fto", amount="amount", days=30)
    return r if works is None else r.join(works, "work_id")


@query("d2_split_payments", f"WITH {_SPLITS} SELECT account, fto, window_count, CAST(tot AS DOUBLE) AS window_total, round(least(window_count/10.0::DOUBLE, 1), 6) AS confidence, 'high' AS severity "
       "FROM sw WHERE window_count >= 3 AND mx < 50000 AND tot > 100000")
def d2(t: Tables) -> DataFrame:
    return split_rows(t).select("account", "fto", "window_count", F.col("window_total").cast("double").alias("window_total"), rnd("confidence", 6).alias("confidence"), "severity")


_WORK_COST = ("wc AS (SELECT l_orderkey AS work_id, o_custkey AS panchayat, c_nationkey AS district, CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(14,2)) ELSE 0 END) AS DOUBLE) AS labour, "
              "CAST(sum(CASE WHEN l_linestatus <> 'O' THEN CAST(l_extendedprice AS DECIMAL(14,2)) ELSE 0 END) AS DOUBLE) AS material, count(DISTINCT l_suppkey) < count(*) AS shell, max(l_quantity) < 30 AS split "
              "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)")


def work_costs(t: Tables) -> DataFrame:
    """Labour and material of each work, whether an account is paid twice for it, and whether all its payments are small.

    Payments are brought together by work only, once; orders and customers join its one row.
    """
    money = F.col("l_extendedprice").cast("decimal(14,2)")
    labour = F.col("l_linestatus") == "O"
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("account"), F.when(labour, money).otherwise(F.lit(0)).alias("labour"),
        F.when(~labour, money).otherwise(F.lit(0)).alias("material"), F.col("l_quantity").alias("quantity"),
    )
    # a work has few payments
    before = F.lag("account").over(W.partitionBy("work_id").orderBy("account"))
    costs = spread(lines, "work_id").withColumn("_again", F.col("account").isNull() | F.coalesce(F.col("account") == before, F.lit(False))).groupBy("work_id").agg(
        F.sum("labour").cast("double").alias("labour"), F.sum("material").cast("double").alias("material"),
        F.bool_or("_again").alias("shell"), (F.max("quantity") < 30).alias("split"),
    )
    works = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("panchayat"), F.col("c_nationkey").alias("district"))
    return costs.join(works, "work_id").select("work_id", "panchayat", "district", "labour", "material", "shell", "split")


@query("d3_material_ratio", f"WITH {_WORK_COST}, r AS (SELECT *, material/(labour+material) AS mr FROM wc WHERE labour + material > 0) "
       "SELECT work_id, round(mr, 8) AS material_ratio, CASE WHEN mr > 0.6 THEN 'critical' WHEN mr > 0.5 THEN 'high' ELSE 'medium' END AS severity, "
       "round(material - (labour+material)*0.4, 4) AS excess_amount, round(least((mr-0.4)/0.3+0.5, 1), 6) AS confidence FROM r WHERE mr > 0.4")
def d3(t: Tables) -> DataFrame:
    r = payments.material_ratio(work_costs(t), "labour", "material")
    return r.select("work_id", rnd("material_ratio", 8).alias("material_ratio"), "severity", rnd("excess_amount").alias("excess_amount"), rnd("confidence", 6).alias("confidence"))


@query("d5_payment_score", f"WITH {_WORK_COST}, s AS (SELECT *, CASE WHEN labour+material > 0 AND labour/(labour+material) < 0.6 THEN least((0.6 - labour/(labour+material))/0.6*2, 1) END AS v FROM wc) "
       "SELECT panchayat, round((coalesce(sum(v), 0) + least(count(*) FILTER (WHERE shell)*1.0::DOUBLE/count(*)*3, 1) + least(count(*) FILTER (WHERE split)*1.0::DOUBLE/count(*)*2.5, 1))/(count(v)+2), 8) AS payment_score FROM s GROUP BY 1")
def d5(t: Tables) -> DataFrame:
    r = payments.payment_score(work_costs(t), ["panchayat"], labour="labour", material="material", shell="shell", split="split")
    return r.withColumn("payment_score", rnd("payment_score", 8))


def vendor_rows(t: Tables) -> DataFrame:
    """Parts as vendors named after the part, working in customer nations of a material."""
    return roles.payments(t).join(t.part.select(F.col("p_partkey").alias("worker_id"), "p_name", "p_brand"), "worker_id").select(
        F.col("p_brand").alias("district_id"), F.col("worker_id").alias("vendor_id"), F.col("district").alias("gp"), "p_name",
        (F.col("amount") / F.col("quantity")).alias("rate"), "amount",
    )


@query("d4_vendor_pairs", J._pairs_sql("SELECT p_brand AS s, p_partkey AS m, c_nationkey AS i FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", 0.75, 2).replace("s AS scope", "s AS district_id"))
def d4_pairs(t: Tables) -> DataFrame:
    r = payments.vendor_pairs(vendor_rows(t), "district_id", "vendor_id", "gp", 0.75)
    return r.withColumn("similarity", rnd("similarity", 8))


# the pass again: a cluster takes its members out only where it shows a sign
_VENDORS = ("vp AS (SELECT p_brand AS s, p_partkey AS m, p_name, c_nationkey AS gp, l_extendedprice/l_quantity AS rate FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), "
            "o AS (SELECT s, m, list(DISTINCT gp) AS l, count(DISTINCT gp) AS n, sum(rate) AS rs, count(rate) AS rn, list_distinct(list_filter(string_split(lower(max(p_name)), ' '), lambda z: z <> '')) AS w, row_number() OVER (PARTITION BY s ORDER BY m) AS k FROM vp GROUP BY 1, 2), "
            "p AS (SELECT s, ka, kb FROM (SELECT a.s, a.k AS ka, b.k AS kb, a.n + b.n AS nn, len(list_intersect(a.l, b.l)) AS o FROM o a JOIN o b ON a.s = b.s AND a.k < b.k) WHERE o >= 2 AND o >= 0.75*(nn - o) - 1e-12), "
            "j AS (SELECT o.s, o.k, coalesce(list(kb ORDER BY kb) FILTER (WHERE kb IS NOT NULL), []) AS nb FROM o LEFT JOIN p ON p.s = o.s AND ka = o.k GROUP BY 1, 2), "
            "al AS (SELECT s, list(l ORDER BY k) AS ls, list(rs ORDER BY k) AS rss, list(rn ORDER BY k) AS rns, list(w ORDER BY k) AS ws FROM o GROUP BY 1), "
            "r(s, k, taken, mem, common, inflated, alike) AS (SELECT s, CAST(0 AS BIGINT), []::BIGINT[], []::BIGINT[], CAST(0 AS BIGINT), false, false FROM al UNION ALL "
            "SELECT s, k, CASE WHEN common >= 3 OR inflated OR alike THEN list_concat(taken, mem) ELSE taken END, mem, common, inflated, alike FROM (SELECT q.s, q.k, taken, mem, "
            "CAST(CASE WHEN len(mem) > 1 THEN len(list_reduce(list_transform(mem, lambda z: ls[z]), lambda u, v: list_intersect(u, v))) ELSE 0 END AS BIGINT) AS common, "
            "len(mem) > 1 AND (list_sum(list_transform(mem, lambda z: rss[z]))/list_sum(list_transform(mem, lambda z: rns[z])) - 1000)/1000*100 > 25 AS inflated, "
            "len(list_filter(mem, lambda u: len(list_filter(mem, lambda v: v > u AND 2*len(list_intersect(ws[u], ws[v])) > len(list_distinct(list_concat(ws[u], ws[v]))))) > 0)) > 0 AS alike "
            "FROM (SELECT r.s, j.k, r.taken, CASE WHEN list_contains(r.taken, j.k) THEN [] ELSE list_prepend(j.k, list_filter(j.nb, lambda z: NOT list_contains(r.taken, z))) END AS mem FROM r JOIN j ON j.s = r.s AND j.k = r.k + 1) q JOIN al ON al.s = q.s)), "
            "cl AS (SELECT r.s AS district_id, o.m AS leader, len(mem) AS vendors, common AS common_panchayats, concat_ws(',', CASE WHEN inflated THEN 'rate_inflation' END, CASE WHEN common >= 3 THEN 'shared_multiple_panchayats' END, CASE WHEN alike THEN 'similar_vendor_names' END) AS indicators, mem "
            "FROM r JOIN o ON o.s = r.s AND o.k = r.k WHERE len(mem) > 1 AND (common >= 3 OR inflated OR alike))")


@query("d4_vendor_clusters", f"WITH RECURSIVE {_VENDORS} SELECT district_id, leader, CAST(vendors AS BIGINT) AS vendors, common_panchayats, indicators FROM cl")
def d4(t: Tables) -> DataFrame:
    return clusters(t).select("district_id", "leader", "vendors", "common_panchayats", F.array_join("indicators", ",").alias("indicators"))


def clusters(t: Tables) -> DataFrame:
    std = t.part.select(F.col("p_brand").alias("district_id"), F.lit(1000.0).alias("rate")).distinct()
    return payments.vendor_clusters(
        vendor_rows(t), std, district="district_id", vendor="vendor_id", panchayat="gp", name="p_name", rate="rate", amount="amount", threshold=0.75
    )
