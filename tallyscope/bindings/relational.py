"""Filters, paging, set operations and aggregations on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.scalar import severity_rank
from ..operators import lookup, rollup, sequences
from ..plans import findings as fnd
from . import roles
from .base import Tables, query, rnd
from .roles import ANOMALIES, AREAS, PANCHAYATS, PAYMENTS, WORKS


@query("f1_search_districts", f"WITH {PANCHAYATS} SELECT panchayat, panchayat_name, block, district_name, state_name FROM panchayats "
       "WHERE (CAST(state AS VARCHAR) = 'asia' OR lower(state_name) LIKE '%asia%') AND lower(block) = 'building' AND balance > 0 "
       "AND (lower(panchayat_name) LIKE '%1%' OR lower(district_name) LIKE '%1%')")
def f1(t: Tables) -> DataFrame:
    p = roles.panchayats(t).withColumn("is_active", F.col("balance") > 0)
    r = lookup.search_areas(
        p, code="state", state="asia", exact={"block": "building"}, active="is_active", search="1",
        names=("panchayat_name", "district_name"),
    )
    return r.select("panchayat", "panchayat_name", "block", "district_name", "state_name")


@query("f2_search_states", f"WITH {AREAS} SELECT * FROM areas WHERE lower(state_name) = 'europe' AND lower(district_name) LIKE '%nation%'")
def f2(t: Tables) -> DataFrame:
    return lookup.search_areas(roles.areas(t), exact={"state_name": "EUROPE"}, search="Nation", names=("district_name",))


@query("f3_search_works", f"WITH {WORKS} SELECT work_id, work_type, status, fin_year, amount, district_name FROM works "
       "WHERE lower(district_name) LIKE '%nation_1%' AND lower(panchayat_name) LIKE '%customer%' AND work_type = '2-HIGH' "
       "AND fin_year = '1997-1998' AND amount >= 100000 AND amount <= 300000")
def f3(t: Tables) -> DataFrame:
    r = lookup.search_records(
        roles.works(t), parts={"district_name": "Nation_1", "panchayat_name": "customer"},
        exact={"work_type": "2-HIGH", "fin_year": "1997-1998", "status": None}, ranges={"amount": (100_000, 300_000)},
    )
    return r.select("work_id", "work_type", "status", "fin_year", "amount", "district_name")


@query("f4_search_anomalies", f"WITH {ANOMALIES} SELECT anomaly_id, severity, loss FROM anomalies WHERE anomaly_type = 'error' "
       "AND status = 'open' AND lower(district_name) LIKE '%nation%' AND CAST(detected_at AS DATE) >= DATE '2024-01-05' "
       "AND CAST(detected_at AS DATE) <= DATE '2024-01-20'")
def f4(t: Tables) -> DataFrame:
    a = roles.anomalies(t).withColumn("detected_on", F.to_date("detected_at"))
    r = lookup.search_records(
        a, parts={"district_name": "nation"}, exact={"anomaly_type": "error", "status": "open"},
        ranges={"detected_on": (F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))},
    )
    return r.select("anomaly_id", "severity", "loss")


@query("f5_newest_reports", "SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND lower(source) LIKE '%src1%'")
def f5(t: Tables) -> DataFrame:
    r = lookup.search_records(t.documents, parts={"source": "SRC1"}, exact={"lang": "en"})
    return lookup.newest_first(r.select("doc_id", "source", "lang"), "doc_id", "doc_id")


@query("f6_summary_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def f6(t: Tables) -> DataFrame:
    return lookup.summary(t.customer, ("c_custkey", "c_name"), "c_mktsegment")


@query("f7_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def f7(t: Tables) -> DataFrame:
    return lookup.search_records(t.orders, exact={"o_orderkey": 7}).select("o_orderkey", "o_custkey", "o_totalprice")


@query("f8_state_with_children",
       "SELECT r_regionkey AS state, r_name, coalesce(string_agg(n_nationkey || ':' || n_name, '|' ORDER BY n_nationkey), '') AS children "
       "FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def f8(t: Tables) -> DataFrame:
    r = lookup.with_children(
        t.region.withColumnRenamed("r_regionkey", "state"), t.nation.withColumnRenamed("n_regionkey", "state"),
        "state", ["n_nationkey", "n_name"],
    )
    text = F.transform("children", lambda c: F.concat_ws(":", c["n_nationkey"].cast("string"), c["n_name"]))
    return r.select("state", "r_name", F.array_join(text, "|").alias("children"))


@query("f9_features_of_state", f"WITH {AREAS} SELECT district, district_name FROM areas WHERE state = 2 OR lower(state_name) LIKE '%2%'")
def f9(t: Tables) -> DataFrame:
    return lookup.search_areas(roles.areas(t), code="state", state="2").select("district", "district_name")


@query("f10_topic_routing",
       "SELECT doc_id, regexp_matches(lower(text), 'network|circular|hub account') AS network, "
       "regexp_matches(lower(text), 'muster|attendance') AS muster_roll, regexp_matches(lower(text), 'the|und|les') AS other FROM documents")
def f10(t: Tables) -> DataFrame:
    tagged = t.documents.withColumn("topics", TX.topics(F.col("text"), {**TX.TOPIC_WORDS, "other": "the|und|les"}))
    return tagged.select("doc_id", *[F.array_contains("topics", c).alias(c) for c in ("network", "muster_roll", "other")])


@query("f11_work_children", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 42 "
       "ORDER BY l_linenumber DESC, l_partkey LIMIT 3 OFFSET 1")
def f11(t: Tables) -> DataFrame:
    rows = lookup.search_records(t.lineitem, exact={"l_orderkey": 42})
    return lookup.page(rows, "l_linenumber", "l_partkey", 1, 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# -- sorts and top-k ------------------------------------------------------------

@query("l1_sorted_works", f"WITH {WORKS} SELECT work_id, fin_year, amount FROM works WHERE status = 'P'")
def l1(t: Tables) -> DataFrame:
    w = roles.works(t).filter(F.col("status") == "P").select("work_id", "fin_year", "amount")
    return lookup.sort_by(w, "amount", "work_id")


@query("l2_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def l2(t: Tables) -> DataFrame:
    return lookup.page(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 100, 50)


@query("l2_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def l2_total(t: Tables) -> DataFrame:
    return lookup.total(t.orders.filter(F.col("o_orderstatus") == "F"))


@query("l3_top_risk", f"WITH {PANCHAYATS} SELECT panchayat, district_name, balance FROM panchayats WHERE balance > 0 "
       "ORDER BY balance DESC, panchayat LIMIT 25")
def l3(t: Tables) -> DataFrame:
    p = roles.panchayats(t).filter(F.col("balance") > 0).select("panchayat", "district_name", "balance")
    return lookup.top(p, 25, F.col("balance").desc(), F.col("panchayat"))


@query("l4_priority_list", f"WITH {ANOMALIES} SELECT anomaly_id, loss, status FROM anomalies WHERE loss >= 70 "
       "ORDER BY loss DESC, anomaly_id LIMIT 50")
def l4(t: Tables) -> DataFrame:
    a = roles.anomalies(t).filter(F.col("loss") >= 70).select("anomaly_id", "loss", "status")
    return lookup.top(a, 50, F.col("loss").desc(), F.col("anomaly_id"))


@query("l5_top_works", f"WITH {WORKS} SELECT work_id, work_type, amount FROM works WHERE district = 3 AND fin_year = '1996-1997' "
       "AND amount > 100000 ORDER BY amount DESC, work_id LIMIT 5")
def l5(t: Tables) -> DataFrame:
    w = roles.works(t).filter((F.col("district") == 3) & (F.col("fin_year") == "1996-1997") & (F.col("amount") > 100_000))
    return lookup.top(w.select("work_id", "work_type", "amount"), 5, F.col("amount").desc(), F.col("work_id"))


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@query("l6_by_severity", f"WITH {ANOMALIES} SELECT anomaly_id, severity, {_RANK} AS severity_rank, loss FROM anomalies")
def l6(t: Tables) -> DataFrame:
    a = roles.anomalies(t).select("anomaly_id", "severity", severity_rank(F.col("severity")).alias("severity_rank"), "loss")
    return lookup.by_severity(a, "severity", "loss", "anomaly_id")


@query("l7_top_discrepancies",
       "SELECT l_orderkey, l_partkey, l_suppkey, round(l_discount*100, 4) AS discrepancy_pct, l_extendedprice FROM lineitem "
       "ORDER BY l_discount DESC, l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey LIMIT 20")
def l7(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", rnd(F.col("l_discount") * 100).alias("discrepancy_pct"), "l_extendedprice"
    )
    return lookup.top(
        rows, 20, F.col("discrepancy_pct").desc(), F.col("l_extendedprice").desc(), *map(F.col, ("l_orderkey", "l_partkey", "l_suppkey"))
    )


@query("l8_pending_jobs", "SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS queued FROM orders WHERE o_orderstatus = 'O'")
def l8(t: Tables) -> DataFrame:
    jobs = t.orders.filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("queued"))
    return jobs.orderBy("o_orderpriority", "queued", "o_orderkey")


# -- set operations ---------------------------------------------------------------

@query("u1_union_distinct", "SELECT o_orderpriority AS officer, c_nationkey AS posted FROM orders JOIN customer ON o_custkey = c_custkey "
       "UNION SELECT 'BDO', n_nationkey FROM nation WHERE n_regionkey IN (0, 1)")
def u1(t: Tables) -> DataFrame:
    approving = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderpriority").alias("officer"), F.col("c_nationkey").alias("posted")
    )
    posted = t.nation.filter(F.col("n_regionkey").isin(0, 1)).select(F.lit("BDO").alias("officer"), F.col("n_nationkey").alias("posted"))
    return approving.union(posted).distinct()


@query("u2_findings_union",
       "SELECT 'cash' AS category, CAST(o_orderkey AS VARCHAR) AS entity, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS detail "
       "FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'stock', CAST(p_partkey AS VARCHAR), NULL, p_name FROM part WHERE p_retailprice > 1000")
def u2(t: Tables) -> DataFrame:
    a = t.orders.filter("o_totalprice > 400000").select(
        F.lit("cash").alias("category"), F.col("o_orderkey").cast("string").alias("entity"), F.col("o_totalprice").alias("amount"))
    b = t.part.filter("p_retailprice > 1000").select(
        F.lit("stock").alias("category"), F.col("p_partkey").cast("string").alias("entity"), F.col("p_name").alias("detail"))
    return fnd.union_all([a, b])


@query("u3_set_algebra",
       "WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type) || ' ' || p_name, ' ')) AS b FROM part) "
       "SELECT p_partkey, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS joined FROM w")
def u3(t: Tables) -> DataFrame:
    a = F.array_distinct(F.split("p_name", " "))
    b = F.array_distinct(F.split(F.concat_ws(" ", F.lower("p_type"), "p_name"), " "))
    return t.part.select(
        "p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("common"), F.size(F.array_union(a, b)).cast("long").alias("joined")
    )


@query("u4_distinct_blocks", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def u4(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


# -- aggregations -------------------------------------------------------------------

_A1 = """
    , base AS (SELECT *, CAST(amount AS DECIMAL(14,2)) AS exp, status <> 'P' AS active, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS done,
        1 AS cnt, (work_id % 100)::DOUBLE AS risk FROM works),
    g AS (SELECT state, district, CAST(sum(exp) AS DOUBLE) AS amount, sum(done)::BIGINT AS completed, sum(cnt)::BIGINT AS total,
        coalesce(sum(risk*exp) FILTER (WHERE active), 0) / CASE WHEN sum(exp) FILTER (WHERE active) = 0 THEN 1
        ELSE coalesce(CAST(sum(exp) FILTER (WHERE active) AS DOUBLE), 1) END AS risk_score,
        count(*) FILTER (WHERE active) AS active_units, count(*) AS units,
        2 - (grouping(state) + grouping(district)) AS level
        FROM base GROUP BY ROLLUP (state, district))
    SELECT state, district, amount, completed, total, round(risk_score, 6) AS risk_score, active_units, units,
        CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 55 THEN 'high' WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END AS risk_band,
        round(completed*1.0/greatest(total, 1)*100, 6) AS completion_rate_pct, CAST(level AS INTEGER) AS level FROM g
"""


@query("a1_area_rollup", f"WITH {WORKS}" + _A1)
def a1(t: Tables) -> DataFrame:
    base = roles.works(t).select(
        "state", "district", F.col("amount").cast("decimal(14,2)").alias("amount"),
        (F.col("status") != "P").alias("active"), (F.col("status") == "F").cast("long").alias("completed"),
        F.lit(1).cast("long").alias("total"), (F.col("work_id") % 100).cast("double").alias("risk"),
    )
    r = rollup.area_rollup(
        base, ["state", "district"], ["amount", "completed", "total"], risk="risk", weight="amount",
        active="active", done="completed", total="total",
    )
    return r.withColumns({
        "amount": F.col("amount").cast("double"), "risk_score": rnd("risk_score", 6),
        "completion_rate_pct": rnd("completion_rate_pct", 6),
    })


@query("a1_map_sums", f"WITH {WORKS} SELECT state, string_agg(work_type || '=' || n, ',' ORDER BY work_type) AS by_type "
       "FROM (SELECT state, work_type, count(*)*2 AS n FROM works GROUP BY 1, 2) GROUP BY 1")
def a1_maps(t: Tables) -> DataFrame:
    w = roles.works(t).select("state", F.create_map("work_type", F.lit(2)).alias("by_type"))
    r = rollup.map_sums(w, ["state"], "by_type")
    text = F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return r.select("state", F.array_join(text, ",").alias("by_type"))


@query("a2_weighted_risk", "SELECT l_suppkey, round(coalesce(sum(l_discount*l_quantity) FILTER (WHERE l_returnflag <> 'N'), 0) / "
       "coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'N'), 1), 8) AS risk FROM lineitem GROUP BY 1")
def a2(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        rnd(rollup.weighted_risk("l_discount", "l_quantity", F.col("l_returnflag") != "N"), 8).alias("risk")
    )


@query("a3_national_counts", f"WITH {PANCHAYATS} SELECT count(DISTINCT state) AS states, count(DISTINCT district) AS districts, "
       "count(*) AS panchayats, count(*) FILTER (WHERE balance > 0) AS active FROM panchayats")
def a3(t: Tables) -> DataFrame:
    return roles.panchayats(t).agg(
        F.count_distinct("state").alias("states"), F.count_distinct("district").alias("districts"),
        F.count(F.lit(1)).alias("panchayats"), F.count_if(F.col("balance") > 0).alias("active"),
    )


@query("a4_leakage_by_share", f"WITH {ANOMALIES}, p AS (SELECT anomaly_type, count(*) AS c, sum(CAST(loss AS DECIMAL(14,2))) AS a FROM anomalies GROUP BY 1) "
       "SELECT anomaly_type, c AS count, round(CAST(sum(a) OVER () AS DOUBLE)*c/sum(c) OVER (), 4) AS estimated_amount FROM p")
def a4(t: Tables) -> DataFrame:
    r = rollup.share_out(roles.anomalies(t), "anomaly_type", F.col("loss").cast("decimal(14,2)").cast("double"))
    return r.select("anomaly_type", "count", rnd("estimated_amount").alias("estimated_amount"))


@query("a5_anomaly_summary", f"WITH {ANOMALIES} " + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS count, round(avg(confidence), 8) AS mean_confidence FROM anomalies GROUP BY {d}"
    for d in ("anomaly_type", "severity", "status")) + " UNION ALL SELECT 'total', 'all', count(*), round(avg(confidence), 8) FROM anomalies")
def a5(t: Tables) -> DataFrame:
    r = rollup.breakdowns(roles.anomalies(t), ["anomaly_type", "severity", "status"], "confidence")
    return r.withColumn("mean_confidence", rnd("mean_confidence", 8))


@query("a6_type_means", f"WITH {ANOMALIES} SELECT anomaly_type, count(*) AS count, round(avg(loss), 6) AS mean_loss FROM anomalies GROUP BY 1")
def a6(t: Tables) -> DataFrame:
    return roles.anomalies(t).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"), rnd(F.avg("loss"), 6).alias("mean_loss"))


@query("a7_case_stats", f"WITH {ANOMALIES} SELECT district, count(*) FILTER (WHERE status IN ('open','under_investigation')) AS open_cases, "
       "count(*) FILTER (WHERE detected_at >= TIMESTAMP '2024-01-15') AS new_cases, round(CAST(sum(CAST(loss AS DECIMAL(14,2))) AS DOUBLE), 2) AS total_suspicious_amount, "
       "count(DISTINCT w) AS flagged_works FROM (SELECT *, unnest([user_id, user_id + 1]) AS w, row_number() OVER () AS rn FROM anomalies) "
       "GROUP BY district".replace("count(*) FILTER", "count(DISTINCT anomaly_id) FILTER").replace(
           "sum(CAST(loss AS DECIMAL(14,2)))", "sum(CAST(loss AS DECIMAL(14,2)))/2"))
def a7(t: Tables) -> DataFrame:
    cases = roles.anomalies(t).withColumn("work_ids", F.array(F.col("user_id"), F.col("user_id") + 1)).withColumn(
        "loss", F.col("loss").cast("decimal(14,2)"))
    r = rollup.case_stats(cases, ["district"], status="status", created="detected_at", start="2024-01-15", works="work_ids", loss="loss")
    return r.withColumn("total_suspicious_amount", rnd("total_suspicious_amount", 2))


@query("a8_weekly_stats", f"WITH {ANOMALIES} SELECT district, CAST(date_trunc('week', detected_at) AS DATE) AS week, count(*) AS new_anomalies, "
       "count(*) FILTER (WHERE status = 'closed' AND updated_at >= date_trunc('week', detected_at)) AS resolved_cases, "
       "count(*) FILTER (WHERE status = 'escalated' AND updated_at >= date_trunc('week', detected_at)) AS escalated_cases, "
       "CAST(sum(CAST(loss AS DECIMAL(14,2))) AS DOUBLE) AS suspicious_amount FROM anomalies GROUP BY 1, 2")
def a8(t: Tables) -> DataFrame:
    a = roles.anomalies(t).withColumn("loss", F.col("loss").cast("decimal(14,2)"))
    r = rollup.weekly_stats(a, ["district"], detected="detected_at", updated="updated_at", status="status", loss="loss")
    return r.withColumn("suspicious_amount", F.col("suspicious_amount").cast("double"))


@query("a9_top_types", f"WITH {ANOMALIES}, c AS (SELECT district, anomaly_type, count(*) AS count FROM anomalies WHERE detected_at BETWEEN "
       "TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY count DESC, anomaly_type) AS rank FROM c) "
       "SELECT district, anomaly_type, count, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def a9(t: Tables) -> DataFrame:
    a = roles.anomalies(t).filter(F.col("detected_at").between("2024-01-05", "2024-01-25"))
    return rollup.top_kinds(a, ["district"], "anomaly_type", 3)


@query("a10_monthly_registrations", f"WITH {WORKS} SELECT district, strftime(day, '%Y-%m') AS month, CAST(month(day) AS INTEGER) AS month_num, count(*) AS count "
       "FROM works WHERE day >= DATE '2000-08-01' - INTERVAL 24 MONTH GROUP BY 1, 2, 3")
def a10(t: Tables) -> DataFrame:
    return rollup.monthly_counts(roles.works(t), ["district"], "day", "2000-08-01")


@query("a11_average_rates", f"WITH {PAYMENTS} SELECT district, material_type, round(avg(amount/quantity), 5) AS avg_rate FROM payments GROUP BY 1, 2")
def a11(t: Tables) -> DataFrame:
    return roles.payments(t).groupBy("district", "material_type").agg(rnd(F.avg(F.col("amount") / F.col("quantity")), 5).alias("avg_rate"))


@query("a12_account_profile", f"WITH {PAYMENTS} SELECT account, count(DISTINCT panchayat) AS panchayats, count(DISTINCT work_id) AS works, "
       "count(DISTINCT worker_id) AS workers, CAST(sum(CAST(amount AS DECIMAL(14,2))) AS DOUBLE) AS total_amount, count(*) AS transactions FROM payments GROUP BY 1")
def a12(t: Tables) -> DataFrame:
    p = roles.payments(t).withColumn("amount", F.col("amount").cast("decimal(14,2)"))
    r = rollup.distinct_profile(p, ["account"], {"panchayats": "panchayat", "works": "work_id", "workers": "worker_id"}, "amount")
    return r.withColumn("total_amount", F.col("total_amount").cast("double"))


@query("a16_severity_histogram", f"WITH {ANOMALIES} SELECT district, severity, count(*) AS count FROM anomalies GROUP BY 1, 2")
def a16(t: Tables) -> DataFrame:
    return roles.anomalies(t).groupBy("district", "severity").agg(F.count(F.lit(1)).alias("count"))


@query("a17_facts_in_crore", "SELECT p_partkey, round(p_retailprice/100, 4) AS retail_crore FROM part")
def a17(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.col("p_retailprice").alias("retail_lakhs"))
    return rollup.facts_in_crore(p, ["retail_lakhs"]).select("p_partkey", rnd("retail_crore").alias("retail_crore"))


@query("a18_hierarchy", f"WITH {PANCHAYATS}, m AS (SELECT state, district, string_agg(DISTINCT block, ',' ORDER BY block) AS l FROM panchayats GROUP BY 1, 2) "
       "SELECT state, string_agg(district || ':' || l, ';' ORDER BY district) AS tree FROM m GROUP BY 1")
def a18(t: Tables) -> DataFrame:
    r = rollup.hierarchy(roles.panchayats(t), "state", "district", "block")
    text = F.transform("middles", lambda m: F.concat_ws(":", m["district"].cast("string"), F.array_join(m["leaves"], ",")))
    return r.select("state", F.array_join(text, ";").alias("tree"))


# -- windows --------------------------------------------------------------------------

_DAILY = f"WITH {ANOMALIES}, d AS (SELECT district, CAST(detected_at AS DATE) AS day, count(*) AS detected, count(*) FILTER (WHERE status <> 'open') + count(*) FILTER (WHERE severity = 'high') AS resolved FROM anomalies GROUP BY 1, 2)"


@query("w1_backlog", _DAILY + ", s AS (SELECT *, sum(detected - resolved) OVER w AS s FROM d WINDOW w AS (PARTITION BY district ORDER BY day)), "
       "m AS (SELECT *, min(s) OVER (PARTITION BY district ORDER BY day) AS lo FROM s) "
       "SELECT district, day, detected, resolved, CAST(s - least(0, lo) AS BIGINT) AS pending FROM m")
def w1(t: Tables) -> DataFrame:
    a = roles.anomalies(t).groupBy("district", F.to_date("detected_at").alias("day")).agg(
        F.count(F.lit(1)).alias("detected"),
        (F.count_if(F.col("status") != "open") + F.count_if(F.col("severity") == "high")).alias("resolved"),
    )
    return sequences.backlog(a, ["district"], "day", "detected", "resolved")


@query("w2_day_streaks", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), "
       "i AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS g FROM d) "
       "SELECT user_id, min(d) AS streak_start, max(d) AS streak_end, count(*) AS days FROM i GROUP BY user_id, g HAVING count(*) > 14")
def w2(t: Tables) -> DataFrame:
    return sequences.day_streaks(t.events, ["user_id"], "ts", 14)


_SESSION = """
WITH o AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 10800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM o)
"""


@query("w3_gap_sessions", _SESSION + "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS rows, "
       "round((max(epoch_us(ts)) - min(epoch_us(ts)))/1e6, 3) AS span_seconds FROM s GROUP BY 1, 2")
def w3(t: Tables) -> DataFrame:
    r = sequences.gap_sessions(t.events, ["user_id"], "ts", "event_id", 10_800)
    return r.select("user_id", "session", "rows", rnd("span_seconds", 3).alias("span_seconds"))


@query("w4_close_pairs", "WITH o AS (SELECT user_id, event_id, lead(event_id) OVER w AS next_id, (lead(epoch_us(ts)) OVER w - epoch_us(ts))/1e6 AS g "
       "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, next_id, round(g, 3) AS gap_seconds FROM o WHERE g < 600")
def w4(t: Tables) -> DataFrame:
    r = sequences.close_pairs(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 600)
    return r.select("user_id", "event_id", "next_id", rnd("gap_seconds", 3).alias("gap_seconds"))


@query("w5_forward_window", "WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(14,2)) AS amt, o_orderdate AS d FROM orders) "
       "SELECT a.o_custkey, a.o_orderkey, count(*) AS window_count, CAST(sum(b.amt) AS DOUBLE) AS window_total, "
       "count(*) FILTER (WHERE b.amt >= 400000) AS window_marked "
       "FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND (b.d > a.d OR (b.d = a.d AND b.o_orderkey >= a.o_orderkey)) "
       "AND b.d < a.d + INTERVAL 31 DAY GROUP BY 1, 2")
def w5(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").alias("amt"), "o_orderdate")
    r = sequences.forward_window(o, ["o_custkey"], "o_orderdate", "o_orderkey", "amt", 30, F.col("amt") >= 400_000)
    return r.select("o_custkey", "o_orderkey", "window_count", F.col("window_total").cast("double").alias("window_total"), "window_marked")


@query("w6_primary_per_group", f"WITH {ANOMALIES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, anomaly_type ORDER BY confidence DESC, detected_at, anomaly_id) AS rn FROM anomalies) "
       "SELECT user_id, anomaly_type, anomaly_id, confidence FROM r WHERE rn = 1")
def w6(t: Tables) -> DataFrame:
    a = roles.anomalies(t).select("user_id", "anomaly_type", "anomaly_id", "confidence", "detected_at")
    return sequences.primary_per_group(a, ["user_id", "anomaly_type"], "confidence", "detected_at", "anomaly_id").drop("detected_at")


@query("w9_apportion", f"WITH {WORKS}, w AS (SELECT state, district, count(*) AS weight FROM works GROUP BY 1, 2), "
       "r AS (SELECT *, CAST(1000*weight AS DOUBLE)/sum(weight) OVER (PARTITION BY state) AS raw FROM w), "
       "f AS (SELECT *, floor(raw) AS b, raw - floor(raw) AS fr FROM r), "
       "p AS (SELECT *, 1000 - sum(b) OVER (PARTITION BY state) AS lft, row_number() OVER (PARTITION BY state ORDER BY fr DESC, district) AS pos FROM f) "
       "SELECT state, district, weight, CAST(b + CASE WHEN pos <= lft THEN 1 ELSE 0 END AS BIGINT) AS allotted FROM p")
def w9(t: Tables) -> DataFrame:
    w = roles.works(t).groupBy("state", "district").agg(F.count(F.lit(1)).alias("weight"))
    return sequences.apportion(w, ["state"], "weight", "district", F.lit(1000))


@query("w10_latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, "
       "arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def w10(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return sequences.latest_per_key(o, ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("w11_mode_per_group", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS f FROM events GROUP BY 1, 2), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) SELECT user_id, event_type, n FROM r WHERE rn = 1")
def w11(t: Tables) -> DataFrame:
    return sequences.mode_per_group(t.events, ["user_id"], "event_type", "ts", "event_id")


@query("w12_period_change", f"WITH {WORKS}, m AS (SELECT district, fin_year, count(*) AS flagged FROM works WHERE status = 'F' GROUP BY 1, 2), "
       "p AS (SELECT *, lag(flagged) OVER (PARTITION BY district ORDER BY fin_year) AS previous FROM m) "
       "SELECT district, fin_year, flagged, previous, flagged - previous AS change, round((flagged - previous)*100.0/previous, 6) AS change_pct, "
       "CASE WHEN flagged > previous THEN 'increasing' WHEN flagged < previous THEN 'decreasing' ELSE 'stable' END AS trend FROM p WHERE previous IS NOT NULL")
def w12(t: Tables) -> DataFrame:
    m = roles.works(t).filter(F.col("status") == "F").groupBy("district", "fin_year").agg(F.count(F.lit(1)).alias("flagged"))
    return sequences.period_change(m, ["district"], "fin_year", "flagged").withColumn("change_pct", rnd("change_pct", 6))


@query("w7_moving_average", "SELECT user_id, CAST(day AS DATE) AS day, n, round(avg(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS moving_avg "
       "FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def w7(t: Tables) -> DataFrame:
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sequences.centred_mean(daily, ["user_id"], "day", "n", 3).withColumn("moving_avg", rnd("moving_avg", 6))


@query("w8_rank_weighted_sum", "WITH r AS (SELECT l_suppkey, l_quantity AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS i FROM lineitem) "
       "SELECT l_suppkey, count(*) AS n, CAST(sum(i*v) AS DOUBLE) AS rank_weighted FROM r GROUP BY 1")
def w8(t: Tables) -> DataFrame:
    return sequences.rank_weighted_sum(t.lineitem, ["l_suppkey"], "l_quantity").select("l_suppkey", "n", "rank_weighted")
