"""Joins, set and hash similarity on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins, similarity
from . import roles
from .base import Tables, query, rnd
from .roles import ANOMALIES, AREAS, PANCHAYATS, PAYMENTS, WORKS

# -- worker profile: customers as job cards, events as log-ins, orders as musters, items as wages


def worker_tables(t: Tables) -> dict[str, DataFrame]:
    key = F.col("c_custkey")
    return {
        "cards": t.customer.select(
            key.alias("worker_id"), F.col("c_name").alias("job_card_number"), F.col("c_nationkey").alias("panchayat_id"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 60).cast("int")).alias("registration_date"),
            F.concat(F.lit("A"), key.cast("string")).alias("aadhaar_number"),
        ),
        "logs": t.events.select(F.col("user_id").alias("worker_id"), "ts"),
        "musters": t.orders.select(
            F.col("o_custkey").alias("worker_id"), F.col("o_orderkey").alias("work_id"),
            (F.col("o_orderkey") % 7).alias("person_days"), F.to_date("o_orderdate").alias("from_date"),
        ),
        "wages": t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("worker_id"), F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"),
            (F.col("l_tax") > 0.07).alias("is_dbt"),
        ),
        "audit": t.customer.filter(F.col("c_acctbal") < 1000).select(
            F.concat(F.lit("A"), key.cast("string")).alias("aadhaar_number"),
            F.array_compact(F.array(
                F.when(F.col("c_acctbal") < 0, "multi_panchayat"), F.when(F.col("c_acctbal") > -500, "sequential_number"),
            )).alias("flags"),
        ),
    }


def profiles(t: Tables) -> DataFrame:
    w = worker_tables(t)
    return joins.worker_profiles(w["cards"], w["logs"], w["musters"], w["wages"], w["audit"])


PROFILES = """
    prof AS (SELECT c_custkey AS worker_id, c_nationkey AS panchayat_id, DATE '1995-01-01' + CAST(c_custkey % 60 AS INTEGER) AS registration_date,
        coalesce(bio.n, 0) AS biometric_auth_count, coalesce(att.d, 0) AS total_person_days, att.f AS first_work_date,
        coalesce(pay.w, 0) AS total_wages, coalesce(pay.dbt, true) AS has_dbt_payment,
        c_acctbal < 0 AS multi, c_acctbal < 1000 AND c_acctbal > -500 AS seqn
    FROM customer
    LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) bio ON bio.user_id = c_custkey
    LEFT JOIN (SELECT o_custkey, CAST(sum(o_orderkey % 7) AS BIGINT) AS d, CAST(min(o_orderdate) AS DATE) AS f FROM orders GROUP BY 1) att ON att.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS w, bool_or(l_tax > 0.07) AS dbt
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) pay ON pay.o_custkey = c_custkey)
"""


@query("j1_worker_profiles", f"WITH {PROFILES} SELECT worker_id, panchayat_id, biometric_auth_count, total_person_days, total_wages, "
       "has_dbt_payment, first_work_date, multi AS multi_panchayat FROM prof")
def j1(t: Tables) -> DataFrame:
    return profiles(t).select(
        "worker_id", "panchayat_id", "biometric_auth_count", "total_person_days", "total_wages", "has_dbt_payment",
        "first_work_date", F.coalesce(F.array_contains("aadhaar_flags", "multi_panchayat"), F.lit(False)).alias("multi_panchayat"),
    )


@query("j2_transfers", "SELECT l_orderkey AS work_id, l_suppkey AS account, l_partkey AS worker_id, l_extendedprice AS amount, n_name, s_name AS bank, p_name AS worker_name "
       "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey "
       "LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey")
def j2(t: Tables) -> DataFrame:
    fto = t.lineitem.select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("account"),
                            F.col("l_partkey").alias("worker_id"), F.col("l_extendedprice").alias("amount"))
    works = t.orders.select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("panchayat"))
    gps = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("panchayat"), "n_name")
    accounts = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("account"), F.col("s_name").alias("bank"))
    cards = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("worker_id"), F.col("p_name").alias("worker_name"))
    return joins.transfers(fto, works, gps, accounts, cards).select("work_id", "account", "worker_id", "amount", "n_name", "bank", "worker_name")


def _material(t: Tables, required: bool) -> DataFrame:
    pay = t.lineitem.select(F.col("l_suppkey").alias("vendor_id"), F.col("l_orderkey").alias("work_id"),
                            F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("material_type"))
    works = t.orders.select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("panchayat"))
    vendors = t.supplier.filter("s_nationkey < 20").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"))
    return joins.material_payments(pay, works, vendors, required).select("vendor_id", "work_id", "amount", "material_type", "panchayat", "vendor_name")


_MATERIAL = ("SELECT l_suppkey AS vendor_id, l_orderkey AS work_id, l_extendedprice AS amount, l_returnflag AS material_type, o_custkey AS panchayat, "
             "s_name AS vendor_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey {how} JOIN (SELECT * FROM supplier WHERE s_nationkey < 20) ON s_suppkey = l_suppkey")


@query("j3_material_payments", _MATERIAL.format(how="LEFT"))
def j3(t: Tables) -> DataFrame:
    return _material(t, False)


@query("j5_vendor_data", _MATERIAL.format(how=""))
def j5(t: Tables) -> DataFrame:
    return _material(t, True)


@query("j4_account_map", "SELECT l_suppkey AS account, o_custkey AS panchayat, s_name AS bank, l_partkey AS worker_id, l_extendedprice AS amount "
       "FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def j4(t: Tables) -> DataFrame:
    fto = t.lineitem.select(F.col("l_suppkey").alias("account"), F.col("l_orderkey").alias("work_id"),
                            F.col("l_partkey").alias("worker_id"), F.col("l_extendedprice").alias("amount"))
    works = t.orders.select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("panchayat"))
    accounts = t.supplier.select(F.col("s_suppkey").alias("account"), F.col("s_name").alias("bank"))
    return joins.account_map(fto, works, accounts).select("account", "panchayat", "bank", "worker_id", "amount")


def wage_records(t: Tables) -> DataFrame:
    """Items as payments, orders as musters, nation and year as the rate key."""
    p = roles.payments(t)
    wages = p.select(
        "worker_id", "work_id", F.col("work_id").alias("muster_roll_id"), "line", "account", F.col("amount").alias("amount_paid"),
        F.col("district").alias("state_code"), F.year("paid_on").alias("financial_year"), F.col("quantity").alias("person_days"),
    )
    musters = t.orders.select(F.col("o_orderkey").alias("muster_roll_id"))
    rates = roles.payments(t).groupBy(F.col("district").alias("state_code"), F.year("paid_on").alias("financial_year")).agg(
        (F.sum(F.col("amount").cast("decimal(14,2)")).cast("double") / F.sum("quantity")).alias("wage_rate")
    )
    works = t.orders.select(F.col("o_orderkey").alias("work_id"), "o_orderstatus")
    return joins.wage_records(wages, musters, rates, works)


WAGES = (PAYMENTS + ", rates AS (SELECT district, year(paid_on) AS y, CAST(sum(CAST(amount AS DECIMAL(14,2))) AS DOUBLE)/sum(quantity) AS wage_rate FROM payments GROUP BY 1, 2), "
         "wr AS (SELECT p.*, wage_rate FROM payments p JOIN rates r ON p.district = r.district AND year(paid_on) = r.y)")


@query("j6_wage_records", f"WITH {WAGES} SELECT worker_id, work_id, account, quantity AS person_days, round(wage_rate, 6) AS wage_rate, amount AS amount_paid FROM wr")
def j6(t: Tables) -> DataFrame:
    return wage_records(t).select("worker_id", "work_id", "account", "person_days", rnd("wage_rate", 6).alias("wage_rate"), "amount_paid")


@query("j7_attendance_between", f"WITH {PANCHAYATS} SELECT event_id, user_id AS work_id, CAST(ts AS DATE) AS day, district FROM events JOIN panchayats ON user_id = panchayat "
       "WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def j7(t: Tables) -> DataFrame:
    att = t.events.select("event_id", F.col("user_id").alias("work_id"), F.to_date("ts").alias("day"))
    works = roles.panchayats(t).select(F.col("panchayat").alias("work_id"), "district")
    return joins.attendance_between(att, works, "day", "2024-01-10", "2024-01-20").select("event_id", "work_id", "day", "district")


@query("j8_results_of_year", f"WITH {WORKS} SELECT l_orderkey AS work_id, l_partkey, l_suppkey, l_linestatus, panchayat, fin_year FROM lineitem JOIN works ON l_orderkey = work_id WHERE fin_year = '1998-1999'")
def j8(t: Tables) -> DataFrame:
    res = t.lineitem.select(F.col("l_orderkey").alias("work_id"), "l_partkey", "l_suppkey", "l_linestatus")
    w = roles.works(t).select("work_id", "panchayat", "fin_year")
    return joins.results_of_year(res, w, "1998-1999")


@query("j9_works_account_flag", "SELECT o_orderkey AS work_id, o_orderkey % 100 AS account, coalesce(m, false) AS multi_panchayat_account FROM orders "
       "LEFT JOIN (SELECT s_suppkey, s_acctbal > 5000 AS m FROM supplier WHERE s_nationkey < 15) ON s_suppkey = o_orderkey % 100")
def j9(t: Tables) -> DataFrame:
    w = t.orders.select(F.col("o_orderkey").alias("work_id"), (F.col("o_orderkey") % 100).alias("account"))
    a = t.supplier.filter("s_nationkey < 15").select(F.col("s_suppkey").alias("account"), (F.col("s_acctbal") > 5000).alias("multi_panchayat"))
    return joins.works_with_account_flag(w, a).select("work_id", "account", "multi_panchayat_account")


@query("j10_blocks_with_risk", "SELECT c_custkey AS block_id, coalesce(risk_level, 'low') AS risk_level, coalesce(flagged_works, 0) AS flagged_works, risk_score "
       "FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS scan_date, count(*) AS flagged_works, max(o_totalprice) AS risk_score, "
       "CASE WHEN max(o_totalprice) > 400000 THEN 'high' ELSE 'medium' END AS risk_level FROM orders GROUP BY 1) ON o_custkey = c_custkey AND scan_date >= DATE '2000-06-01'")
def j10(t: Tables) -> DataFrame:
    blocks = t.customer.select(F.col("c_custkey").alias("block_id"))
    scores = t.orders.groupBy(F.col("o_custkey").alias("block_id")).agg(
        F.to_date(F.max("o_orderdate")).alias("scan_date"), F.count(F.lit(1)).alias("flagged_works"), F.max("o_totalprice").alias("risk_score"),
        F.when(F.max("o_totalprice") > 400_000, "high").otherwise("medium").alias("risk_level"),
    )
    return joins.blocks_with_risk(blocks, scores, "2000-06-01")


@query("j11_enrich_last_wins", f"WITH {AREAS}, u AS (SELECT upper(n_name) AS n, arg_max(o_totalprice, o_orderkey) AS amt FROM orders JOIN customer ON o_custkey = c_custkey "
       "JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20 GROUP BY 1) "
       "SELECT district, state_name, district_name, coalesce(amt, 0.0::DOUBLE) AS amount, amt IS NOT NULL AS is_updated FROM areas LEFT JOIN u ON n = upper(district_name)")
def j11(t: Tables) -> DataFrame:
    base = roles.areas(t).select("district", "state_name", "district_name", F.lit(0.0).alias("amount"))
    upd = roles.works(t).filter("district < 20").select(
        F.lower("state_name").alias("state_name"), F.concat(F.lit(" "), F.lower("district_name")).alias("district_name"), "amount", "work_id"
    )
    return joins.enrich(base, upd, ["state_name", "district_name"], ["amount"], ["work_id"])


@query("j12_members_of", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE value > 150)")
def j12(t: Tables) -> DataFrame:
    ids = t.events.filter("value > 150").select(F.col("user_id").alias("o_custkey"))
    return joins.members_of(t.orders.select("o_orderkey", "o_custkey"), ids, "o_custkey")


def _pairs_sql(source: str, threshold: float, shared: int, fold: bool = True) -> str:
    """Class pairs by brute force over all members; ``source`` gives (s, m, i)."""
    return f"""
    WITH x AS (SELECT DISTINCT s, m, i FROM ({source})), l AS (SELECT s, m, list_sort(list(i)) AS l, count(*) AS n FROM x GROUP BY 1, 2),
    c AS (SELECT s, l, n, min(m) AS rep, count(*) AS members FROM l GROUP BY 1, 2, 3),
    p AS (SELECT a.s, a.rep AS a, b.rep AS b, a.n AS size_a, b.n AS size_b, len(list_intersect(a.l, b.l)) AS overlap,
            a.members AS members_a, b.members AS members_b FROM c a JOIN c b ON a.s = b.s AND (a.rep < b.rep OR (a.rep = b.rep AND a.members > 1))
            AND least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) - 1e-9)
    SELECT s AS scope, a, b, size_a, size_b, CAST(overlap AS BIGINT) AS overlap, round(overlap*1.0::DOUBLE/(size_a+size_b-overlap), 8) AS similarity, members_a, members_b
    FROM p WHERE overlap >= {shared} AND overlap >= {threshold}*(size_a+size_b-overlap) - 1e-12
    """


@query("j13_set_similarity_join", _pairs_sql(
    "SELECT c_nationkey AS s, l_orderkey AS m, l_suppkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", 0.6, 2))
def j13(t: Tables) -> DataFrame:
    rows = roles.payments(t).select(F.col("district").alias("scope"), F.col("work_id").alias("m"), F.col("account").alias("i"))
    r = similarity.jaccard_pairs(rows, ["scope"], "m", "i", 0.6, 2)
    return r.withColumn("similarity", rnd("similarity", 8))


def order_hashes(t: Tables) -> DataFrame:
    """64-bit hash of each order: its customer's, with up to six bits turned by the order, so that near copies abound."""
    digest = F.md5(F.col("o_custkey").cast("string"))
    half = [F.conv(F.substring(digest, a, 8), 16, 10).cast("long") for a in (1, 9)]
    turned = F.lit(0).cast("long")
    for i in range(6):
        bit = F.expr(f"shiftleft(1L, CAST((o_orderkey * {2 * i + 7} + {11 * i}) % 64 AS INT))")
        turned = turned.bitwiseXOR(F.when(F.col("o_orderkey") % 7 > i, bit).otherwise(F.lit(0).cast("long")))
    h = F.shiftleft(half[0], 32).bitwiseOR(half[1]).bitwiseXOR(turned)
    rows = t.orders.withColumn("h64", h).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", F.col("c_nationkey").alias("scope"), "h64")


def _turned_sql() -> str:
    value = "('0x' || md5(CAST(o_custkey AS VARCHAR))[1:16])::UBIGINT"
    for i in range(6):
        bit = f"1::UBIGINT << ((o_orderkey * {2 * i + 7} + {11 * i}) % 64)::INT"
        value = f"xor({value}, CASE WHEN o_orderkey % 7 > {i} THEN {bit} ELSE 0::UBIGINT END)"
    return value


HASH = f"h AS (SELECT o_orderkey AS id, c_nationkey AS scope, {_turned_sql()} AS h FROM orders JOIN customer ON o_custkey = c_custkey)"


def _hamming_sql(distance: int, scope: str = "") -> str:
    """``scope`` is empty or ``scope,``."""
    same, out = ("a.scope = b.scope AND", "a.scope,") if scope else ("", "")
    return (f"WITH {HASH}, f AS (SELECT {scope} h, min(id) AS rep, count(*) AS members FROM h GROUP BY {scope} h) "
            f"SELECT {out} a.rep AS a, b.rep AS b, a.members AS members_a, b.members AS members_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance "
            f"FROM f a JOIN f b ON {same} (a.rep < b.rep OR (a.rep = b.rep AND a.members > 1)) AND bit_count(xor(a.h, b.h)) <= {distance}")


@query("j14_hamming_join", _hamming_sql(10))
def j14(t: Tables) -> DataFrame:
    return similarity.hamming_pairs(order_hashes(t), [], "o_orderkey", "h64", 10)


@query("j14_hamming_scoped", _hamming_sql(10, "scope,"))
def j14_scoped(t: Tables) -> DataFrame:
    return similarity.hamming_pairs(order_hashes(t), ["scope"], "o_orderkey", "h64", 10)


@query("j15_best_scenes", f"""
    WITH {PAYMENTS}, sc AS (SELECT DISTINCT district AS tile, paid_on AS scene_day, quantity*2 AS cloud, work_id*1000 + worker_id AS scene_id FROM payments WHERE quantity*2 <= 30),
    w AS (SELECT o_orderkey AS work_id, c_nationkey AS tile, CAST(o_orderdate AS DATE) AS s FROM orders JOIN customer ON o_custkey = c_custkey),
    win AS (SELECT work_id, tile, 'before' AS phase, s - 60 AS lo, s - 5 AS hi FROM w UNION ALL SELECT work_id, tile, 'after', s + 30 + 5, s + 30 + 60 FROM w),
    j AS (SELECT win.work_id, phase, min((cloud, scene_day, scene_id)) AS b FROM win JOIN sc ON win.tile = sc.tile AND scene_day BETWEEN lo AND hi GROUP BY 1, 2)
    SELECT work_id, phase, b[3] AS scene_id, b[2] AS scene_day, b[1] AS cloud FROM j
    """)
def j15(t: Tables) -> DataFrame:
    scenes = roles.payments(t).select(
        F.col("district").alias("tile"), F.col("paid_on").alias("scene_day"), (F.col("quantity") * 2).alias("cloud"),
        (F.col("work_id") * 1000 + F.col("worker_id")).alias("scene_id"),
    )
    w = roles.works(t).select("work_id", F.col("district").alias("tile"), F.col("day").alias("start_day"), F.date_add("day", 30).alias("end_day"))
    return joins.best_scenes(w, scenes, "tile", "work_id", "start_day", "end_day")


@query("j16_measure_compare", "WITH d AS (SELECT l_orderkey AS work_id, sum(l_quantity) AS detected FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), "
       "r AS (SELECT l_orderkey AS work_id, sum(l_quantity) AS reported FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), "
       "b AS (SELECT coalesce(d.work_id, r.work_id) AS work_id, detected, reported, CASE WHEN detected IS NOT NULL AND reported IS NOT NULL THEN 100*abs(detected-reported)/abs(reported) END AS p FROM d FULL JOIN r ON d.work_id = r.work_id) "
       "SELECT work_id, detected, reported, detected - reported AS difference, round(p, 6) AS pct_deviation, CASE WHEN p IS NULL THEN 'MISSING_DATA' WHEN p > 50 THEN 'CRITICAL' WHEN p > 20 THEN 'WARNING' ELSE 'OK' END AS flag FROM b")
def j16(t: Tables) -> DataFrame:
    li = t.lineitem.withColumnRenamed("l_orderkey", "work_id")
    d = li.filter("l_linestatus = 'F'").groupBy("work_id").agg(F.sum("l_quantity").alias("detected"))
    r = li.filter("l_returnflag = 'A'").groupBy("work_id").agg(F.sum("l_quantity").alias("reported"))
    return joins.compare_measures(d, r, ["work_id"]).withColumn("pct_deviation", rnd("pct_deviation", 6))


_HAV = ("2*6371000.0*atan2(sqrt(hv), sqrt(1-hv))")


@query("j17_within_distance", f"""
    WITH p AS (SELECT o_orderkey AS point_id, -89 + (o_orderkey*7919 % 178000)/1000.0::DOUBLE AS lat, -180 + (o_orderkey*104729 % 360000)/1000.0::DOUBLE AS lon FROM orders),
    s AS (SELECT c_custkey AS site_id, -89 + (c_custkey*31337 % 178000)/1000.0::DOUBLE AS slat, -180 + (c_custkey*65537 % 360000)/1000.0::DOUBLE AS slon FROM customer),
    j AS (SELECT *, power(sin(radians(slat-lat)/2),2) + cos(radians(lat))*cos(radians(slat))*power(sin(radians(slon-lon)/2),2) AS hv
          FROM p JOIN s ON abs(slat-lat) < 1)
    SELECT point_id, site_id, round({_HAV}, 3) AS distance_m FROM j WHERE {_HAV} <= 100000
    """)
def j17(t: Tables) -> DataFrame:
    def place(key: str, a: int, b: int) -> tuple[Column, Column]:
        return -89 + (F.col(key) * a % 178000) / F.lit(1000.0), -180 + (F.col(key) * b % 360000) / F.lit(1000.0)

    lat, lon = place("o_orderkey", 7919, 104729)
    slat, slon = place("c_custkey", 31337, 65537)
    points = t.orders.select(F.col("o_orderkey").alias("point_id"), lat.alias("lat"), lon.alias("lon"))
    sites = t.customer.select(F.col("c_custkey").alias("site_id"), slat.alias("site_lat"), slon.alias("site_lon"))
    r = joins.within_distance(points, sites, 100_000)
    return r.select("point_id", "site_id", rnd("distance_m", 3).alias("distance_m"))


@query("j18_routing", f"WITH {ANOMALIES} SELECT anomaly_id, CASE anomaly_type WHEN 'error' THEN 'a,c' WHEN 'click' THEN 'a' ELSE 'z' END AS agents FROM anomalies")
def j18(t: Tables) -> DataFrame:
    r = joins.route(roles.anomalies(t), "anomaly_type", {"error": ("a", "c"), "click": ("a",)}, ("z",))
    return r.select("anomaly_id", F.array_join("agents", ",").alias("agents"))
