"""Scalar functions on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo, scalar, text
from .base import Tables, query, rnd


def _digit_sql(expr: str) -> str:
    return f"CAST(substr(CAST(CAST(floor(abs({expr})) AS BIGINT) AS VCHAR), 1, 1) AS INTEGER)".replace("VCHAR", "VARCHAR")


@query("x1_first_digits", "SELECT event_id, CASE WHEN value > 0 AND try_cast(substr(regexp_replace(printf('%.10f', value), '^0*\\.?', ''), 1, 1) AS INTEGER) >= 1 "
       "THEN try_cast(substr(regexp_replace(printf('%.10f', value), '^0*\\.?', ''), 1, 1) AS INTEGER) END AS text_digit, "
       f"CASE WHEN value >= 1 THEN {_digit_sql('value')} END AS whole_digit, "
       "CAST(substr(regexp_replace(printf('%.10f', value), '^[0.]*', ''), 1, 1) AS INTEGER) AS strict_digit FROM events")
def x1(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select(
        "event_id", scalar.first_digit_text(v).alias("text_digit"), scalar.first_digit_whole(v).alias("whole_digit"),
        scalar.first_digit_strict(v).alias("strict_digit"),
    )


@query("x2_risk_band", "SELECT event_id, CASE WHEN value >= 75 THEN 'critical' WHEN value >= 55 THEN 'high' WHEN value >= 35 THEN 'medium' ELSE 'low' END AS band FROM events")
def x2(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalar.risk_band(F.col("value")).alias("band"))


@query("x3_indian_money", r"""
    WITH v AS (SELECT o_orderkey, CAST(o_totalprice * 100 AS BIGINT) * (o_orderkey % 1000 + 1) AS paise FROM orders),
    a AS (SELECT *, CAST(paise // 100 AS VARCHAR) AS s, paise % 100 AS c, paise / 100.0::DOUBLE AS w FROM v),
    g AS (SELECT *, CASE WHEN length(s) > 3 THEN ltrim(reverse(regexp_replace(reverse(s[1:length(s)-3]), '(\d{2})', '\1,', 'g')), ',') || ',' || right(s, 3) ELSE s END
          || CASE WHEN c > 0 THEN '.' || lpad(CAST(c AS VARCHAR), 2, '0') ELSE '' END AS grouped FROM a)
    SELECT o_orderkey, grouped,
      CASE WHEN w >= 10000000 THEN 'Rs ' || regexp_replace(CAST(CAST(round(w / 10000000, 2) AS DECIMAL(30,2)) AS VARCHAR), '0$', '') || ' Cr'
           WHEN w >= 100000 THEN 'Rs ' || regexp_replace(CAST(CAST(round(w / 100000, 2) AS DECIMAL(30,2)) AS VARCHAR), '0$', '') || ' L'
           ELSE 'Rs ' || grouped END AS amount
    FROM g
    """)
def x3(t: Tables) -> DataFrame:
    w = F.round(F.col("o_totalprice") * 100).cast("long") * (F.col("o_orderkey") % 1000 + 1) / F.lit(100.0)
    return t.orders.select("o_orderkey", scalar.indian_grouping(w).alias("grouped"), scalar.human_amount(w).alias("amount"))


@query("x4_safe_parse", "SELECT event_id, coalesce(try_cast(regexp_replace(props, '[^0-9.\\-]', '', 'g') AS DOUBLE), 0) AS as_float, "
       "coalesce(try_cast(regexp_replace(strftime(ts, '%Y-%m-%d'), '[^0-9]', '', 'g') AS BIGINT), 0) AS as_int, strftime(ts, '%Y') AS code FROM events")
def x4(t: Tables) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.events.select(
        "event_id", scalar.safe_float(F.col("props")).alias("as_float"), scalar.safe_int(day).alias("as_int"),
        scalar.location_code(day).alias("code"),
    )


@query("x5_financial_year", "WITH f AS (SELECT o_orderkey, o_orderdate, CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) ELSE year(o_orderdate)-1 END AS y FROM orders) "
       "SELECT o_orderkey, y || '-' || (y+1) AS fin_year, make_date(y, 4, 1) AS fy_start, make_date(y+1, 3, 31) AS fy_end, y >= 2006 AS is_valid FROM f")
def x5(t: Tables) -> DataFrame:
    fy = dates.financial_year(F.col("o_orderdate"))
    return t.orders.select(
        "o_orderkey", fy.alias("fin_year"), dates.financial_year_start(fy).alias("fy_start"), dates.financial_year_end(fy).alias("fy_end"),
        dates.financial_year_valid(fy).alias("is_valid"),
    )


HOLIDAYS = "hol(m, d, name) AS (VALUES " + ", ".join(f"({m}, {d}, '{n}')" for m, d, n in dates.HOLIDAYS) + ")"
REASON = ("CASE WHEN isodow(day) = 7 THEN 'Sunday' WHEN isodow(day) = 6 AND ceil(day(day)/7.0) = 2 THEN '2nd Saturday' "
          "WHEN isodow(day) = 6 AND ceil(day(day)/7.0) = 4 THEN '4th Saturday' ELSE name END")


@query("x6_holidays", f"WITH {HOLIDAYS}, y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders) "
       "SELECT CAST(y AS INTEGER) AS year, make_date(y, m, d) AS holiday, name FROM hol, y")
def x6(t: Tables) -> DataFrame:
    years = t.orders.agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi")).first()
    table = dates.holiday_table(t.spark, years["lo"], years["hi"])
    seen = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    return table.join(seen, "year", "left_semi")


@query("x7_non_working_reason", f"WITH {HOLIDAYS}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) "
       f"SELECT o_orderkey, day, {REASON} AS reason FROM o LEFT JOIN hol ON month(day) = m AND day(day) = d")
def x7(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", day.alias("day"), dates.non_working_reason(day).alias("reason"))


@query("x8_working_days", f"WITH {HOLIDAYS}, cal AS (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS day), "
       f"w AS (SELECT day, ({REASON}) IS NULL AS works FROM cal LEFT JOIN hol ON month(day) = m AND day(day) = d), "
       "c AS (SELECT day, sum(works::INT) OVER (ORDER BY day) AS c FROM w), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS e FROM orders) "
       "SELECT o_orderkey, CAST(b.c - a.c AS INTEGER) AS working_days FROM o JOIN c a ON a.day = s - 1 JOIN c b ON b.day = e")
def x8(t: Tables) -> DataFrame:
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 90).cast("int"))
    return t.orders.select("o_orderkey", dates.working_days(start, end).alias("working_days"))


@query("x9_pass_windows", "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 23 AS INTEGER) AS e FROM orders), "
       "d AS (SELECT o_orderkey, s, e, unnest(generate_series(0, (e - s)::BIGINT, 5)) AS i FROM o) "
       "SELECT o_orderkey, 'before' AS kind, s - 30 AS window_start, s - 1 AS window_end FROM o UNION ALL SELECT o_orderkey, 'after', e + 1, e + 30 FROM o "
       "UNION ALL SELECT o_orderkey, 'during', s + CAST(i AS INTEGER), least(s + CAST(i AS INTEGER) + 4, e) FROM d")
def x9(t: Tables) -> DataFrame:
    start = F.to_date("o_orderdate")
    o = t.orders.select("o_orderkey", start.alias("s"), F.date_add(start, (F.col("o_orderkey") % 23).cast("int")).alias("e"))
    return o.select("o_orderkey", F.inline(dates.pass_windows(F.col("s"), F.col("e"))))


def spot(key: str, a: int, b: int) -> tuple[Column, Column]:
    """A place inside the country derived from a key."""
    return 8 + (F.col(key) * a % 29000) / F.lit(1000.0), 69 + (F.col(key) * b % 28000) / F.lit(1000.0)


def spot_sql(key: str, a: int, b: int) -> tuple[str, str]:
    return f"(8 + ({key}*{a} % 29000)/1000.0::DOUBLE)", f"(69 + ({key}*{b} % 28000)/1000.0::DOUBLE)"


_LA, _LO = spot_sql("o_orderkey", 7919, 104729)
_LB, _LP = spot_sql("o_custkey", 31337, 65537)
_HV = f"(power(sin(radians({_LB}-{_LA})/2),2) + cos(radians({_LA}))*cos(radians({_LB}))*power(sin(radians({_LP}-{_LO})/2),2))"


@query("x10_haversine", f"SELECT o_orderkey, round(2*6371000.0*atan2(sqrt({_HV}), sqrt(1-{_HV}))/1000, 5) AS distance_km FROM orders")
def x10(t: Tables) -> DataFrame:
    (la, lo), (lb, lp) = spot("o_orderkey", 7919, 104729), spot("o_custkey", 31337, 65537)
    return t.orders.select("o_orderkey", rnd(geo.haversine_m(la, lo, lb, lp) / 1000, 5).alias("distance_km"))


@query("x11_hex_hamming", "SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN 64 ELSE CAST(bit_count(xor(CAST('0x' || substr(md5(text), 1, 16) AS UBIGINT)::HUGEINT, "
       "CAST('0x' || substr(md5(lang || source), 1, 16) AS UBIGINT)::HUGEINT)) AS INTEGER) END AS distance FROM documents")
def x11(t: Tables) -> DataFrame:
    a = F.substring(F.md5("text"), 1, 16)
    b = F.substring(F.md5(F.concat("lang", "source")), F.lit(1), F.when(F.length("text") % 5 == 0, 8).otherwise(16))
    return t.documents.select("doc_id", scalar.hex_hamming(a, b).alias("distance"))


@query("x12_name_similarity", """
    WITH w AS (SELECT p_partkey, list_filter(list_distinct(string_split(lower(p_name || ' and co'), ' ')), lambda x: NOT list_contains(['and','the','of','pvt','ltd','co'], x)) AS a,
      list_filter(list_distinct(string_split(lower('hot ' || p_name), ' ')), lambda x: NOT list_contains(['and','the','of','pvt','ltd','co'], x)) AS b FROM part)
    SELECT p_partkey, round(len(list_intersect(a, b))*1.0::DOUBLE/len(list_distinct(list_concat(a, b))), 6) AS similarity,
      len(list_intersect(a, b))*1.0::DOUBLE/len(list_distinct(list_concat(a, b))) > 0.5 AS similar FROM w
    """)
def x12(t: Tables) -> DataFrame:
    a, b = F.concat("p_name", F.lit(" and Co")), F.concat(F.lit("Hot "), "p_name")
    return t.part.select(
        "p_partkey", rnd(text.jaccard(text.name_tokens(a), text.name_tokens(b)), 6).alias("similarity"), text.names_similar(a, b).alias("similar")
    )


@query("x13_work_id_parts", "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_quantity >= 10 THEN CAST(l_suppkey AS VARCHAR) ELSE '00' END AS state_code, "
       "CASE WHEN l_quantity >= 10 THEN CAST(l_partkey AS VARCHAR) ELSE '0000' END AS district_code, CASE WHEN l_quantity >= 10 THEN l_returnflag ELSE '000' END AS block_code, "
       "CASE WHEN l_quantity >= 10 THEN l_linestatus ELSE '000' END AS panchayat_code FROM lineitem")
def x13(t: Tables) -> DataFrame:
    s = F.col("l_suppkey").cast("string")
    wid = F.when(F.col("l_quantity") >= 10, F.concat_ws("/", s, F.col("l_partkey").cast("string"), "l_returnflag", "l_linestatus", F.lit("7"))).otherwise(F.concat_ws("/", s, F.lit("9")))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in scalar.work_id_parts(wid).items()])


@query("x14_paragraph_chunks", """
    WITH RECURSIVE p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents),
    r(doc_id, ps, i, cur, out) AS (
      SELECT doc_id, ps, 0, '', CAST(NULL AS VARCHAR) FROM p
      UNION ALL
      SELECT doc_id, ps, i+1, CASE WHEN length(cur) + length(ps[i+1]) + 2 > 500 THEN ps[i+1] ELSE cur || chr(10) || chr(10) || ps[i+1] END,
        CASE WHEN length(cur) + length(ps[i+1]) + 2 > 500 AND cur <> '' THEN trim(cur, chr(10) || chr(9) || ' ') END
      FROM r WHERE i < len(ps)),
    c AS (SELECT doc_id, i AS k, out AS chunk FROM r WHERE out IS NOT NULL UNION ALL
          SELECT doc_id, 1000000, trim(cur, chr(10) || chr(9) || ' ') FROM r WHERE i = len(ps) AND trim(cur, chr(10) || chr(9) || ' ') <> '')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_no, length(chunk) AS chars, md5(chunk) AS digest FROM c
    """)
def x14(t: Tables) -> DataFrame:
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    chunks = t.documents.select("doc_id", F.posexplode(text.chunk_paragraphs(body, 500)).alias("chunk_no", "chunk"))
    return chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("digest"))


@query("x15_masked_account", "SELECT c_custkey, substr(c_name, 1, 6) || '***' AS masked FROM customer")
def x15(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", scalar.masked_account(F.col("c_name")).alias("masked"))


@query("x16_bounds_problems", f"SELECT o_orderkey, CASE WHEN {_LA} + 0.5 BETWEEN 6 AND 37 THEN '' ELSE 'lat;' END || CASE WHEN {_LO} + 1.2 BETWEEN 68 AND 98 THEN '' ELSE 'lon;' END || "
       "CASE WHEN o_totalprice - 2000 > 0 THEN '' ELSE 'amount;' END AS problems FROM orders")
def x16(t: Tables) -> DataFrame:
    la, lo = spot("o_orderkey", 7919, 104729)
    rows = t.orders.select("o_orderkey", (la + 0.5).alias("lat"), (lo + 1.2).alias("lon"), (F.col("o_totalprice") - 2000).alias("amount"))
    good, bad = scalar.split_valid(rows, scalar.bounds_problems("lat", "lon", ["amount"]))
    all_rows = good.withColumn("problems", F.array().cast("array<string>")).unionByName(bad)
    return all_rows.select("o_orderkey", F.concat_ws("", F.transform("problems", lambda p: F.concat(p, F.lit(";")))).alias("problems"))
