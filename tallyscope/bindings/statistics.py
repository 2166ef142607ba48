"""Statistical detectors on orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats
from .base import Tables, query, rnd


def orders_by_nation(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.col("c_nationkey").alias("nation"), "c_mktsegment",
    )


_ORDERS = "FROM orders JOIN customer ON o_custkey = c_custkey"
_TEXT_DIGIT = (
    "CAST(substr(regexp_replace(printf('%.10f', abs(v)), '^0*\\.?', ''), 1, 1) AS INTEGER)"
)
_LOG = {d: f"log10(1 + 1.0/{d})" for d in range(1, 10)}


def _digit_cte(source: str, digit: str) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE d = {d}) AS d{d}" for d in range(1, 10))
    return (
        f"WITH base AS ({source}), dig AS (SELECT k, {digit} AS d FROM base), "
        f"cnt AS (SELECT k, {cols}, count(*) FILTER (WHERE d BETWEEN 1 AND 9) AS n FROM dig GROUP BY k)"
    )


_CHI = " + ".join(f"power(d{d}*1.0/greatest(n,1) - {p}, 2) / {p}" for d, p in _LOG.items())
_DEVS = [f"abs(d{d}*1.0/greatest(n,1) - {p})" for d, p in _LOG.items()]
_WHOLE = "CASE WHEN floor(abs(v)) >= 1 THEN CAST(substr(CAST(CAST(floor(abs(v)) AS BIGINT) AS VARCHAR),1,1) AS INTEGER) END"
_SRC = f"SELECT c_nationkey AS k, o_totalprice AS v {_ORDERS}"
_ST1 = (
    _digit_cte(_SRC, f"CASE WHEN v <> 0 THEN {_TEXT_DIGIT} END")
    + f", chi AS (SELECT *, CASE WHEN n > 0 THEN n * ({_CHI}) ELSE 0 END AS x FROM cnt)"
    ", p AS (SELECT *, exp(-x/2) * (1 + x/2 + power(x/2,2)/2 + power(x/2,3)/6) AS pv FROM chi)"
)


@query(
    "st1_benford_test",
    _ST1 + " SELECT k AS nation, n AS n_values, round(x, 4) AS chi2_statistic, round(pv, 6) AS p_value, "
    "pv < 0.05 AS is_anomalous FROM p",
)
def st1(t: Tables) -> DataFrame:
    r = stats.benford_test(orders_by_nation(t), ["nation"], "o_totalprice")
    return r.select("nation", "n_values", rnd("chi2_statistic"), rnd("p_value", 6), "is_anomalous").toDF(
        "nation", "n_values", "chi2_statistic", "p_value", "is_anomalous"
    )


@query(
    "st1_benford_digits",
    _ST1 + " SELECT k AS nation, u.digit, round(u.o, 6) AS observed, round(u.e, 6) AS expected, "
    "round(u.o - u.e, 6) AS deviation FROM p, LATERAL (VALUES "
    + ", ".join(f"({d}, d{d}*1.0/greatest(n,1), {p})" for d, p in _LOG.items())
    + ") AS u(digit, o, e)",
)
def st1_digits(t: Tables) -> DataFrame:
    tested = stats.benford_test(orders_by_nation(t), ["nation"], "o_totalprice")
    return stats.benford_digits(tested, ["nation"]).select(
        "nation", "digit", *[rnd(c, 6).alias(c) for c in ("observed", "expected", "deviation")]
    )


@query(
    "st2_benford_score",
    _digit_cte("SELECT l_suppkey AS k, l_quantity AS v FROM lineitem", _WHOLE)
    + ", s AS (SELECT k, n, CASE WHEN n >= 20 THEN 0.4*least((" + _CHI + ")/20, 1) + 0.3*least(("
    + " + ".join(_DEVS) + ")/9/0.05, 1) + 0.3*least(greatest(" + ", ".join(_DEVS) + ")/0.10, 1) ELSE 0 END AS sc FROM cnt)"
    " SELECT k AS supplier, n, round(sc, 6) AS score, sc > 0.15 AS flagged FROM s",
)
def st2(t: Tables) -> DataFrame:
    li = t.lineitem.select(F.col("l_suppkey").alias("supplier"), "l_quantity")
    r = stats.benford_score(li, ["supplier"], "l_quantity")
    return r.select("supplier", "n", rnd("score", 6).alias("score"), "flagged")


@query(
    "st3_benford_deviation",
    _digit_cte("SELECT l_partkey AS k, l_extendedprice AS v FROM lineitem", _WHOLE)
    + " SELECT k AS part, n, round(CASE WHEN n >= 10 THEN least((" + _CHI + ")/0.1, 1) ELSE 0 END, 6) AS deviation FROM cnt",
)
def st3(t: Tables) -> DataFrame:
    li = t.lineitem.select(F.col("l_partkey").alias("part"), "l_extendedprice")
    r = stats.benford_deviation(li, ["part"], "l_extendedprice")
    return r.select("part", "n", rnd("deviation", 6).alias("deviation"))


@query(
    "st4_round_number_bias",
    """
    WITH b AS (SELECT l_suppkey AS supplier, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS w FROM lineitem),
    c AS (SELECT supplier, count(*) AS total,
        count(*) FILTER (WHERE w % 10 = 0) AS round_count,
        count(*) FILTER (WHERE w % 100 = 0) AS suffix_100,
        count(*) FILTER (WHERE w % 10 = 0 AND w % 50 <> 0) AS suffix_10,
        count(*) FILTER (WHERE w % 50 = 0 AND w % 100 <> 0) AS suffix_50 FROM b GROUP BY 1),
    p AS (SELECT supplier, sum(exp(lgamma(total+1) - lgamma(i+1) - lgamma(total-i+1)
            + i*ln(0.1) + (total-i)*ln(0.9))) AS pv
          FROM c, LATERAL (SELECT unnest(generate_series(round_count, total)) AS i) GROUP BY supplier)
    SELECT supplier, total, round_count, suffix_10, suffix_50, suffix_100,
        round(round_count*1.0/total, 6) AS round_pct, round(least(pv, 1), 6) AS binom_p_value, pv < 0.05 AS is_anomalous
    FROM c JOIN p USING (supplier)
    """,
)
def st4(t: Tables) -> DataFrame:
    li = t.lineitem.select(F.col("l_suppkey").alias("supplier"), "l_extendedprice")
    r = stats.round_number_bias(li, ["supplier"], "l_extendedprice", suffixes=(10, 50, 100))
    return r.select(
        "supplier", "total", "round_count", "suffix_10", "suffix_50", "suffix_100",
        rnd("round_pct", 6).alias("round_pct"), rnd("binom_p_value", 6).alias("binom_p_value"), "is_anomalous",
    )


@query(
    "st5_bunching",
    f"""
    WITH c AS (SELECT c_nationkey AS nation, count(*) AS total_amounts,
        count(*) FILTER (WHERE o_totalprice >= 300000*0.95 AND o_totalprice < 300000) AS bunching_count,
        count(*) FILTER (WHERE o_totalprice < 300000) AS below_threshold {_ORDERS} GROUP BY 1),
    e AS (SELECT *, CAST(below_threshold AS DOUBLE)*0.05 AS ex FROM c),
    p AS (SELECT nation, 1 - coalesce(sum(exp(i*ln(ex) - ex - lgamma(i+1))), 0) AS pv
          FROM e, LATERAL (SELECT unnest(generate_series(0, bunching_count-1)) AS i) WHERE ex > 0 AND bunching_count > 0
          GROUP BY nation)
    SELECT nation, total_amounts, bunching_count, below_threshold, round(ex, 4) AS expected_count,
        round(bunching_count/greatest(ex, 1.0), 6) AS ratio, round(coalesce(pv, 1), 6) AS poisson_p_value,
        coalesce(pv, 1) < 0.05 AS is_anomalous
    FROM e LEFT JOIN p USING (nation)
    """,
)
def st5(t: Tables) -> DataFrame:
    r = stats.bunching(orders_by_nation(t), ["nation"], "o_totalprice", 300_000)
    return r.select(
        "nation", "total_amounts", "bunching_count", "below_threshold", rnd("expected_count").alias("expected_count"),
        rnd("ratio", 6).alias("ratio"), rnd("poisson_p_value", 6).alias("poisson_p_value"), "is_anomalous",
    )


def monthly_by_nation(t: Tables) -> DataFrame:
    return (
        orders_by_nation(t)
        .groupBy("nation", F.trunc(F.to_date("o_orderdate"), "month").alias("month"))
        .agg(
            rnd(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double") / 1e6, 2).alias("amount"),
            F.count(F.lit(1)).alias("n"),
        )
    )


_MONTHLY = (
    "SELECT c_nationkey AS nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, "
    f"round(CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE)/1e6, 2) AS amount, count(*) AS n {_ORDERS} GROUP BY 1, 2"
)


def _decompose_sql(mult: bool) -> str:
    minus = "/" if mult else "-"
    return f"""
    WITH m AS (SELECT nation, month, CAST(amount AS DECIMAL(18,2)) AS amount FROM ({_MONTHLY})),
    i AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY month) - 1 AS i,
                 count(*) OVER (PARTITION BY nation) AS cnt FROM m),
    t AS (SELECT *, CASE WHEN i >= 6 AND i < cnt - 6 THEN (CAST(sum(amount) OVER (PARTITION BY nation ORDER BY month
            ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS DOUBLE) - 0.5*CAST(lag(amount, 6) OVER (PARTITION BY nation ORDER BY month)
            + lead(amount, 6) OVER (PARTITION BY nation ORDER BY month) AS DOUBLE))/12 END AS trend FROM i),
    d AS (SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount), i % 12 AS ph, CAST(amount AS DOUBLE) {minus} trend AS det FROM t),
    ph AS (SELECT nation, ph, avg(det ORDER BY month) AS pm FROM d GROUP BY 1, 2),
    c AS (SELECT nation, avg(pm ORDER BY ph) AS cm FROM ph GROUP BY 1),
    s AS (SELECT d.*, pm {minus} cm AS seasonal, amount {minus} trend {minus} (pm {minus} cm) AS residual
          FROM d JOIN ph USING (nation, ph) JOIN c USING (nation)),
    r AS (SELECT nation, avg(residual) AS rm, stddev_samp(residual) AS rs FROM s GROUP BY 1)
    SELECT nation, month, round(amount, 2) AS amount, 12 AS season_length, round(trend, 6) AS trend,
        round(seasonal, 6) AS seasonal, round(residual, 6) AS residual,
        coalesce(rs > 0 AND abs(residual - rm) > 2*rs, false) AS is_anomalous
    FROM s JOIN r USING (nation)
    """


def _decomposed(t: Tables, model: str) -> DataFrame:
    monthly = monthly_by_nation(t).select("nation", "month", F.col("amount").cast("decimal(18,2)").alias("amount"))
    r = stats.seasonal_decompose(monthly, ["nation"], "month", "amount", model)
    return r.select(
        "nation", "month", rnd("amount", 2).alias("amount"), "season_length",
        *[rnd(c, 6).alias(c) for c in ("trend", "seasonal", "residual")], "is_anomalous",
    )


@query("st6_seasonal_additive", _decompose_sql(False))
def st6(t: Tables) -> DataFrame:
    return _decomposed(t, "additive")


@query("st6_seasonal_multiplicative", _decompose_sql(True))
def st6_mult(t: Tables) -> DataFrame:
    return _decomposed(t, "multiplicative")


@query(
    "st7_zscore_outliers",
    """
    WITH m AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
    SELECT event_id, e.event_type, value, round((value - m)/s, 6) AS z_score
    FROM events e JOIN m USING (event_type) WHERE s > 0 AND abs((value - m)/s) > 3
    """,
)
def st7(t: Tables) -> DataFrame:
    ev = t.events.select("event_id", "event_type", "value")
    return stats.zscore_outliers(ev, ["event_type"], "value").withColumn("z_score", rnd("z_score", 6))


EXPENDITURE = """
    s AS (SELECT o_custkey AS k, count(*) AS n, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd,
        quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3,
        count(*) FILTER (WHERE month(o_orderdate) = 3) AS n3,
        sum(o_totalprice) FILTER (WHERE month(o_orderdate) = 3) AS s3,
        avg(o_totalprice) FILTER (WHERE month(o_orderdate) <> 3) AS rest FROM orders GROUP BY 1),
    h AS (SELECT k, count(*) FILTER (WHERE sd > 0 AND abs((o_totalprice - m)/sd) > 2) AS o,
        count(*) FILTER (WHERE o_totalprice > q3 + 1.5*(q3-q1)) AS a FROM orders JOIN s ON o_custkey = k GROUP BY 1),
    x AS (SELECT k, CASE WHEN n > 2 AND sd > 0 THEN least(o*1.0/n*2, 1) END AS z,
        CASE WHEN n >= 4 AND q3 > q1 THEN least(a*1.0/n*2.5, 1) END AS f,
        CASE WHEN n3 > 0 AND rest > 0 THEN least(greatest((s3/(rest*n3) - 2)/3, 0), 1) END AS g
        FROM s JOIN h USING (k)),
    expenditure AS (SELECT k, z, f, g, CASE WHEN z IS NULL AND f IS NULL AND g IS NULL THEN 0 ELSE
        (coalesce(z,0)+coalesce(f,0)+coalesce(g,0)) / ((z IS NOT NULL)::INT + (f IS NOT NULL)::INT + (g IS NOT NULL)::INT) END AS score FROM x)
"""


@query("st8_expenditure_score", f"WITH {EXPENDITURE} SELECT k AS customer, round(z, 6) AS outlier_score, round(f, 6) AS fence_score, round(g, 6) AS surge_score, round(score, 6) AS expenditure_score FROM expenditure")
def st8(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("customer"), "o_totalprice", "o_orderdate")
    r = stats.expenditure_score(o, ["customer"], "o_totalprice", "o_orderdate")
    return r.select("customer", *[rnd(c, 6).alias(c) for c in r.columns if c != "customer"])


_GINI = """
    r AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS i, count(*) OVER (PARTITION BY k) AS n FROM b WHERE v >= 0),
    g AS (SELECT k, max(n) AS n, CASE WHEN sum(v) > 0 THEN
        least(greatest(2*sum(i*v)/(max(n)*sum(v)) - (max(n)+1.0)/max(n), 0), 1) ELSE 0 END AS g FROM r GROUP BY k)
"""


@query(
    "st10_gini",
    f"WITH b AS (SELECT c_nationkey AS k, o_totalprice AS v {_ORDERS}), {_GINI} SELECT k AS nation, n, round(g, 6) AS gini FROM g",
)
def st10(t: Tables) -> DataFrame:
    r = stats.gini(orders_by_nation(t), ["nation"], "o_totalprice")
    return r.select("nation", "n", rnd("gini", 6).alias("gini"))


@query(
    "st12_enrollment_spikes",
    f"""
    WITH m AS ({_MONTHLY}), s AS (SELECT nation, avg(n) AS mu, stddev_pop(n) AS sd, count(*) AS c FROM m GROUP BY 1)
    SELECT nation, month, n, round(mu, 6) AS mean_count, round((n - mu)/sd, 6) AS z_score,
        month(month) IN (2, 3) AS is_year_end, CASE WHEN month(month) IN (2, 3) THEN 'high' ELSE 'medium' END AS severity,
        round(least((n - mu)/sd/5, 1), 6) AS confidence
    FROM m JOIN s USING (nation) WHERE sd > 0 AND c >= 6 AND (n - mu)/sd > 1.5
    """,
)
def st12(t: Tables) -> DataFrame:
    r = stats.spikes(monthly_by_nation(t).drop("amount"), ["nation"], "month", "n", threshold=1.5)
    return r.select(
        "nation", "month", "n", rnd("mean_count", 6).alias("mean_count"), rnd("z_score", 6).alias("z_score"),
        "is_year_end", "severity", rnd("confidence", 6).alias("confidence"),
    )
