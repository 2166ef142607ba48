"""The audit roles played by the benchmark tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import financial_year
from ..session import spread
from .base import Tables

# -- works: orders under customer (panchayat) < nation (district) < region (state)


def areas(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("district"), F.col("n_name").alias("district_name"),
        F.col("r_regionkey").alias("state"), F.col("r_name").alias("state_name"),
    )


def panchayats(t: Tables) -> DataFrame:
    return t.customer.join(areas(t), F.col("c_nationkey") == F.col("district")).select(
        F.col("c_custkey").alias("panchayat"), F.col("c_name").alias("panchayat_name"),
        F.col("c_mktsegment").alias("block"), "district", "district_name", "state", "state_name",
        F.col("c_acctbal").alias("balance"),
    )


def works(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return (
        t.orders.join(panchayats(t), F.col("o_custkey") == F.col("panchayat"))
        .select(
            F.col("o_orderkey").alias("work_id"), F.col("o_orderpriority").alias("work_type"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), day.alias("day"),
            financial_year(day).alias("fin_year"), "panchayat", "panchayat_name", "block", "district",
            "district_name", "state", "state_name",
        )
    )


AREAS = (
    "areas AS (SELECT n_nationkey AS district, n_name AS district_name, r_regionkey AS state, r_name AS state_name "
    "FROM nation JOIN region ON n_regionkey = r_regionkey)"
)
PANCHAYATS = (
    AREAS + ", panchayats AS (SELECT c_custkey AS panchayat, c_name AS panchayat_name, c_mktsegment AS block, "
    "district, district_name, state, state_name, c_acctbal AS balance FROM customer JOIN areas ON c_nationkey = district)"
)
WORKS = (
    PANCHAYATS + ", works AS (SELECT o_orderkey AS work_id, o_orderpriority AS work_type, o_orderstatus AS status, "
    "o_totalprice AS amount, CAST(o_orderdate AS DATE) AS day, "
    "CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) || '-' || (year(o_orderdate)+1) "
    "ELSE (year(o_orderdate)-1) || '-' || year(o_orderdate) END AS fin_year, "
    "panchayat, panchayat_name, block, district, district_name, state, state_name "
    "FROM orders JOIN panchayats ON o_custkey = panchayat)"
)

# -- anomalies: events of users, placed in the user's panchayat


def anomalies(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return (
        t.events.join(panchayats(t), F.col("user_id") == F.col("panchayat"))
        .select(
            F.col("event_id").alias("anomaly_id"), F.col("event_type").alias("anomaly_type"), "user_id",
            F.when(v >= 100, "critical").when(v >= 50, "high").when(v >= 20, "medium").otherwise("low").alias("severity"),
            F.when(k < 25, "open").when(k < 50, "under_investigation").when(k < 75, "closed")
            .otherwise("escalated").alias("status"),
            v.alias("loss"), (k / 100).alias("confidence"), F.col("ts").alias("detected_at"),
            (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, 1)") * (k - 10) * 3600).alias("updated_at"),
            "panchayat", "block", "district", "district_name", "state",
        )
    )


ANOMALIES = (
    PANCHAYATS + ", anomalies AS (SELECT event_id AS anomaly_id, event_type AS anomaly_type, user_id, "
    "CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS severity, "
    "CASE WHEN k < 25 THEN 'open' WHEN k < 50 THEN 'under_investigation' WHEN k < 75 THEN 'closed' ELSE 'escalated' END AS status, "
    "value AS loss, k / 100.0::DOUBLE AS confidence, ts AS detected_at, ts + to_hours(k - 10) AS updated_at, "
    "panchayat, block, district, district_name, state "
    "FROM (SELECT *, CAST(props::JSON->>'k' AS INTEGER) AS k FROM events) JOIN panchayats ON user_id = panchayat)"
)

# -- payments: line items as transfers to an account (supplier) for a worker (part)


def payments(t: Tables) -> DataFrame:
    # orders find their customer first, so that line items travel once, by their order
    works = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "o_orderpriority", "c_nationkey")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    return spread(lines, "l_orderkey").join(works, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("worker_id"), F.col("l_suppkey").alias("account"),
        F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("quantity"),
        F.to_date("l_shipdate").alias("paid_on"), F.col("o_orderpriority").alias("officer"),
        F.col("o_custkey").alias("panchayat"), F.col("c_nationkey").alias("district"), F.col("l_returnflag").alias("material_type"),
        F.col("l_linestatus").alias("line_status"),
    )


PAYMENTS = (
    "payments AS (SELECT l_orderkey AS work_id, l_partkey AS worker_id, l_suppkey AS account, l_linenumber AS line, "
    "l_extendedprice AS amount, l_quantity AS quantity, CAST(l_shipdate AS DATE) AS paid_on, o_orderpriority AS officer, "
    "o_custkey AS panchayat, c_nationkey AS district, l_returnflag AS material_type "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
)
