"""Raster operators on sites of 20 x 20 pixels laid out from order keys.

Each order is one pixel, seen before and after; its price gives sensor noise, and
a strip, a round patch and a pond change between the phases.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from ..operators import raster as R
from .base import Tables, query, rnd

SIDE = 20
BANDS = ("blue", "green", "red", "nir", "swir")
_STRIP = "row BETWEEN 8 AND 10"
_DISC = "(row-14)*(row-14) + (col-5)*(col-5) <= 9"
_POND = "(row-4)*(row-4) + (col-15)*(col-15) <= 6"
_VALUES = {
    "blue": f"CASE WHEN phase = 'after' AND ({_POND}) THEN 0.20D ELSE 0.08D END",
    "green": f"CASE WHEN phase = 'after' AND ({_POND}) THEN 0.30D ELSE 0.12D END",
    "red": f"CASE WHEN phase = 'after' AND ({_STRIP} OR {_DISC}) THEN 0.25D ELSE 0.10D END + n/2000.0D",
    "nir": f"CASE WHEN phase = 'after' AND ({_POND}) THEN 0.05D WHEN phase = 'after' AND ({_STRIP} OR {_DISC}) THEN 0.18D ELSE 0.40D END + n/1000.0D",
    "swir": f"CASE WHEN phase = 'after' AND ({_STRIP} OR {_DISC}) THEN 0.38D ELSE 0.15D END + n/1000.0D",
    "scl": "CASE WHEN n < 3 THEN 9 ELSE 4 END",
}


def pixels(t: Tables) -> DataFrame:
    base = t.orders.select(
        F.floor(F.col("o_orderkey") / (SIDE * SIDE)).alias("site_id"), F.floor(F.col("o_orderkey") % (SIDE * SIDE) / SIDE).cast("int").alias("row"),
        (F.col("o_orderkey") % SIDE).cast("int").alias("col"), F.floor("o_totalprice").cast("long").alias("_n"),
        F.explode(F.array(F.lit("before"), F.lit("after"))).alias("phase"),
    ).withColumn("n", F.when(F.col("phase") == "before", F.col("_n") % 100).otherwise(F.col("_n") * 7 % 100))
    return base.select("site_id", "phase", "row", "col", *[F.expr(v).alias(k) for k, v in _VALUES.items()])


_SQLVAL = {k: re.sub(r"(\d)D\b", r"\1::DOUBLE", v) for k, v in _VALUES.items()}
PIXELS = (
    "px0 AS (SELECT o_orderkey // 400 AS site_id, CAST(o_orderkey % 400 // 20 AS INTEGER) AS row, CAST(o_orderkey % 20 AS INTEGER) AS col, phase, "
    "CASE WHEN phase = 'before' THEN CAST(floor(o_totalprice) AS BIGINT) % 100 ELSE CAST(floor(o_totalprice) AS BIGINT)*7 % 100 END AS n "
    "FROM orders, (VALUES ('before'), ('after')) p(phase)), "
    "px AS (SELECT site_id, phase, row, col, " + ", ".join(f"{v} AS {k}" for k, v in _SQLVAL.items()) + " FROM px0)"
)


def _ix(num: str, den: str, style: str) -> str:
    if style == "zero":
        return f"CASE WHEN {den} <> 0 THEN ({num})/({den}) WHEN {den} = 0 THEN 0.0::DOUBLE END"
    return f"least(greatest(({num})/(CASE WHEN {den} = 0 THEN 1e-10 ELSE {den} END), -1.0::DOUBLE), 1.0::DOUBLE)"


def _index_cte(style: str, source: str = "px") -> str:
    return ("ix AS (SELECT *, " + _ix("nir - red", "(nir + red)", style) + " AS ndvi, " + _ix("green - nir", "(green + nir)", style) + " AS ndwi, "
            + _ix("(swir + red) - (nir + blue)", "((swir + red) + (nir + blue))", style) + " AS bsi, " + _ix("nir - swir", "(nir + swir)", style) + f" AS nbr FROM {source})")


_MASKED = "mk AS (SELECT site_id, phase, row, col, scl, " + ", ".join(
    f"CASE WHEN scl NOT IN (0,1,3,8,9,10,11) THEN {b} END AS {b}" for b in BANDS) + " FROM px)"
_CHANGE = ("ch AS (SELECT b.site_id, b.row, b.col, b.ndvi AS ndvi_before, a.ndvi AS ndvi_after, a.bsi AS bsi_after, a.ndwi AS ndwi_after, a.ndvi - b.ndvi AS d_ndvi, "
           "a.ndwi - b.ndwi AS d_ndwi, a.bsi - b.bsi AS d_bsi FROM ix b JOIN ix a ON a.site_id = b.site_id AND a.row = b.row AND a.col = b.col WHERE b.phase = 'before' AND a.phase = 'after')")


@query("r1_cloud_mask", f"WITH {PIXELS}, {_MASKED} SELECT site_id, phase, row, col, round(nir, 6) AS nir, round(red, 6) AS red FROM mk")
def r1(t: Tables) -> DataFrame:
    m = R.mask_clouds(pixels(t), BANDS)
    return m.select("site_id", "phase", "row", "col", rnd("nir", 6).alias("nir"), rnd("red", 6).alias("red"))


@query("r2_indices", f"WITH {PIXELS}, {_index_cte('zero')} SELECT site_id, phase, row, col, " + ", ".join(f"round({i}, 8) AS {i}" for i in ("ndvi", "ndwi", "bsi", "nbr")) + " FROM ix")
def r2(t: Tables) -> DataFrame:
    return R.indices(pixels(t)).select("site_id", "phase", "row", "col", *[rnd(i, 8).alias(i) for i in ("ndvi", "ndwi", "bsi", "nbr")])


def change_table(t: Tables) -> DataFrame:
    return R.changes(R.indices(R.mask_clouds(pixels(t), BANDS)))


_CLS = (f"{PIXELS}, {_MASKED}, {_index_cte('zero', 'mk')}, {_CHANGE}, "
        "cl AS (SELECT *, coalesce(sqrt(power(d_ndvi,2)+power(d_ndwi,2)+power(d_bsi,2)) > 0.15, false) AS changed, coalesce(d_ndvi < -0.15, false) AS veg_loss, "
        "coalesce(d_ndwi > 0.20, false) AS new_water, coalesce(d_bsi > 0.12, false) AS soil_disturbed FROM ch), "
        "ct AS (SELECT *, CASE WHEN NOT changed THEN 'NO_CHANGE' WHEN veg_loss::INT + new_water::INT + soil_disturbed::INT > 1 THEN 'MIXED_CHANGE' WHEN veg_loss THEN 'VEGETATION_CLEARED' "
        "WHEN new_water THEN 'WATER_BODY_CREATED' WHEN soil_disturbed THEN 'SOIL_DISTURBANCE' ELSE 'UNCLASSIFIED' END AS change_type FROM cl)")


@query("r3_change_masks", f"WITH {_CLS} SELECT site_id, row, col, round(d_ndvi, 8) AS d_ndvi, changed, veg_loss, new_water, soil_disturbed FROM ct")
def r3(t: Tables) -> DataFrame:
    c = R.classified_changes(change_table(t))
    return c.select("site_id", "row", "col", rnd("d_ndvi", 8).alias("d_ndvi"), "changed", "veg_loss", "new_water", "soil_disturbed")


@query("r4_change_types", f"WITH {_CLS} SELECT site_id, change_type, count(*) AS pixels FROM ct GROUP BY 1, 2")
def r4(t: Tables) -> DataFrame:
    return R.classified_changes(change_table(t)).groupBy("site_id", "change_type").agg(F.count(F.lit(1)).alias("pixels"))


@query("r5_change_statistics", f"WITH {_CLS}, s AS (SELECT site_id, count(*) AS total_pixels, count(d_ndvi) AS valid_pixels, count(*) FILTER (WHERE changed AND d_ndvi IS NOT NULL) AS changed_pixels FROM ct GROUP BY 1) "
       "SELECT *, round(100*changed_pixels*1.0::DOUBLE/valid_pixels, 6) AS change_pct, changed_pixels*100.0::DOUBLE AS changed_sqm, round(changed_pixels*100.0::DOUBLE/10000, 6) AS changed_hectares FROM s")
def r5(t: Tables) -> DataFrame:
    s = R.change_statistics(R.classified_changes(change_table(t)), "changed", F.col("d_ndvi").isNotNull())
    return s.withColumns({"change_pct": rnd("change_pct", 6), "changed_hectares": rnd("changed_hectares", 6)})


@query("r6_normalised_bands", f"WITH {PIXELS}, l AS (SELECT site_id, phase, min(nir) AS lo, max(nir) AS hi FROM px GROUP BY 1, 2) "
       "SELECT site_id, phase, row, col, round(CASE WHEN hi > lo THEN (nir-lo)/(hi-lo) ELSE 0 END, 8) AS nir FROM px JOIN l USING (site_id, phase)")
def r6(t: Tables) -> DataFrame:
    n = R.normalise_bands(pixels(t), BANDS)
    return n.select("site_id", "phase", "row", "col", rnd("nir", 8).alias("nir"))


def _otsu_sql(source: str, value: str, name: str) -> str:
    return f"""
    {name}l AS (SELECT site_id, min({value}) AS a, CASE WHEN max({value}) > min({value}) THEN max({value}) - min({value}) ELSE 1 END AS w FROM {source} WHERE {value} IS NOT NULL GROUP BY 1),
    {name}h AS (SELECT site_id, a, w, CAST(least(floor(({value} - a)/w*256), 255) AS INTEGER) AS b, count(*) AS n FROM {source} JOIN {name}l USING (site_id) WHERE {value} IS NOT NULL GROUP BY 1, 2, 3, 4),
    {name}c AS (SELECT *, a + (b + 0.5)*w/256 AS c FROM {name}h),
    {name}r AS (SELECT *, sum(n) OVER u AS wb, sum(n*c) OVER u AS sb, sum(n) OVER (PARTITION BY site_id) AS tt, sum(n*c) OVER (PARTITION BY site_id) AS st FROM {name}c WINDOW u AS (PARTITION BY site_id ORDER BY b)),
    {name} AS (SELECT site_id, arg_max(c, (wb*(tt-wb)*power(sb/wb - (st-sb)/(tt-wb), 2), -b)) AS t FROM {name}r WHERE tt > wb GROUP BY 1)
    """


_EW = (f"{PIXELS}, {_index_cte('epsilon')}, {_CHANGE}, fl AS (SELECT *, -d_ndvi AS fall FROM ch), " + _otsu_sql("fl", "fall", "o1") + ", " + _otsu_sql("fl", "bsi_after", "o2")
       + ", m0 AS (SELECT fl.site_id, row, col, d_ndvi FROM fl JOIN o1 USING (site_id) JOIN o2 USING (site_id) WHERE d_ndvi < -o1.t OR bsi_after > o2.t)")


def _offsets(shape: str, radius: int) -> str:
    return ", ".join(f"({i}, {j})" for i, j in R._shifts(shape, radius))


def _dil(src: str, dst: str, shape: str, radius: int) -> str:
    return (f"{dst} AS (SELECT DISTINCT site_id, row + i AS row, col + j AS col FROM {src}, (VALUES {_offsets(shape, radius)}) o(i, j) "
            f"WHERE row + i BETWEEN 0 AND {SIDE - 1} AND col + j BETWEEN 0 AND {SIDE - 1})")


def _ero(src: str, dst: str, shape: str, radius: int, border: bool = False) -> str:
    k = len(R._shifts(shape, radius))
    out = f"OR NOT (a.row + i BETWEEN 0 AND {SIDE - 1} AND a.col + j BETWEEN 0 AND {SIDE - 1})" if border else ""
    return (f"{dst} AS (SELECT a.site_id, a.row, a.col FROM (SELECT * FROM {src}, (VALUES {_offsets(shape, radius)}) o(i, j)) a "
            f"LEFT JOIN {src} b ON b.site_id = a.site_id AND b.row = a.row + i AND b.col = a.col + j GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE b.site_id IS NOT NULL {out}) = {k})")


def _clean(src: str, dst: str, shape: str, o: int, c: int, border: bool) -> str:
    return ", ".join([
        _ero(src, dst + "e", shape, o, border), _dil(dst + "e", dst + "o", shape, o), _dil(dst + "o", dst + "d", shape, c), _ero(dst + "d", dst, shape, c, border),
    ])


def _comp(src: str, dst: str) -> str:
    return (f"{dst}r AS (SELECT site_id, row AS r0, col AS c0, row, col FROM {src} UNION SELECT r.site_id, r0, c0, m.row, m.col FROM {dst}r r JOIN {src} m ON m.site_id = r.site_id "
            f"AND abs(m.row - r.row) + abs(m.col - r.col) = 1), {dst} AS (SELECT site_id, row, col, min(r0::BIGINT*2147483648 + c0) AS label FROM {dst}r GROUP BY 1, 2, 3)")


@query("r7_otsu_threshold", f"WITH {PIXELS}, {_index_cte('epsilon')}, {_CHANGE}, fl AS (SELECT *, -d_ndvi AS fall FROM ch), " + _otsu_sql("fl", "fall", "o1") + " SELECT site_id, round(t, 8) AS threshold FROM o1")
def r7(t: Tables) -> DataFrame:
    ch = R.changes(R.indices(pixels(t), "epsilon")).withColumn("fall", -F.col("d_ndvi"))
    return R.otsu(ch, ["site_id"], "fall").withColumn("threshold", rnd("threshold", 8))


def earthwork(t: Tables) -> tuple[DataFrame, DataFrame]:
    return R.earthwork_mask(pixels(t), SIDE, SIDE)


@query("r8_earthwork_change", f"WITH {_EW}, {_clean('m0', 'mc', 'square', 1, 1, False)} SELECT site_id, count(*) AS pixels, round(avg(d_ndvi), 8) AS mean_change FROM mc JOIN ch USING (site_id, row, col) GROUP BY 1")
def r8(t: Tables) -> DataFrame:
    raw, ch = earthwork(t)
    clean = R.open_close(raw)
    size = clean.groupBy("site_id").agg(F.count(F.lit(1)).alias("pixels"))
    return size.join(R.mean_change(clean, ch), "site_id").withColumn("mean_change", rnd("mean_change", 8))


@query("r9_morphology_square", f"WITH {_EW}, {_clean('m0', 'mc', 'square', 1, 1, False)} SELECT site_id, row, col FROM mc")
def r9(t: Tables) -> DataFrame:
    return R.open_close(earthwork(t)[0]).select("site_id", "row", "col")


@query("r9_morphology_disk", f"WITH {_EW}, {_clean('m0', 'mc', 'disk', 1, 2, True)} SELECT site_id, row, col FROM mc")
def r9_disk(t: Tables) -> DataFrame:
    return R.open_close(earthwork(t)[0], "disk", 1, 2, border=True).select("site_id", "row", "col")


_LAB = f"WITH RECURSIVE {_EW}, {_comp('m0', 'lb')}, big AS (SELECT site_id, label FROM lb GROUP BY 1, 2 HAVING count(*) >= 5), lc AS (SELECT lb.* FROM lb JOIN big USING (site_id, label))"


@query("r10_components", _LAB + " SELECT site_id, row, col, label FROM lc")
def r10(t: Tables) -> DataFrame:
    return R.components(earthwork(t)[0], at_least=5).select("site_id", "row", "col", "label")


_MET = (", bd AS (SELECT a.site_id, a.label, a.row, a.col, count(b.site_id) AS k FROM lc a LEFT JOIN lc b ON a.site_id = b.site_id AND a.label = b.label AND abs(a.row-b.row) + abs(a.col-b.col) = 1 GROUP BY 1, 2, 3, 4), "
        "mt AS (SELECT site_id, label, count(*) AS pixels, count(*) FILTER (WHERE k < 4) AS boundary, avg(row) AS centre_row, avg(col) AS centre_col, CAST(max(row)-min(row)+1 AS INTEGER) AS box_height, CAST(max(col)-min(col)+1 AS INTEGER) AS box_width FROM bd GROUP BY 1, 2)")


@query("r11_component_metrics", _LAB + _MET + " SELECT site_id, label, pixels, boundary, round(centre_row, 6) AS centre_row, round(centre_col, 6) AS centre_col, box_height, box_width, "
       "round(greatest(box_height, box_width)*1.0::DOUBLE/least(box_height, box_width), 6) AS aspect, round(least(4*pi()*pixels/power(boundary, 2), 1), 6) AS compactness FROM mt")
def r11(t: Tables) -> DataFrame:
    m = R.component_metrics(R.components(earthwork(t)[0], at_least=5))
    return m.select("site_id", "label", "pixels", "boundary", *[rnd(c, 6).alias(c) for c in ("centre_row", "centre_col", "aspect", "compactness")], "box_height", "box_width")


@query("r12_water_bodies", f"WITH RECURSIVE {PIXELS}, {_index_cte('zero')}, m0 AS (SELECT site_id, row, col FROM ix WHERE phase = 'after' AND ndwi > 0), {_clean('m0', 'mc', 'disk', 1, 2, True)}, {_comp('mc', 'lb')} "
       "SELECT site_id, label, count(*) AS pixels, count(*)*100.0::DOUBLE AS area_sqm FROM lb GROUP BY 1, 2 HAVING count(*) >= 5")
def r12(t: Tables) -> DataFrame:
    px = R.indices(pixels(t)).filter("phase = 'after'")
    return R.water_bodies(px, SIDE, SIDE).select("site_id", "label", "pixels", "area_sqm")


@query("r12_levelled_patches", f"WITH RECURSIVE {PIXELS}, {_index_cte('zero')}, {_CHANGE}, m0 AS (SELECT site_id, row, col FROM ch WHERE d_bsi > 0.10), {_clean('m0', 'mc', 'disk', 2, 3, True)}, {_comp('mc', 'lb')} "
       "SELECT site_id, label, count(*) AS pixels, round(avg(d_bsi), 8) AS mean_bsi_change FROM lb JOIN ch USING (site_id, row, col) GROUP BY 1, 2 HAVING count(*) >= 5 "
       "AND greatest(max(row)-min(row)+1, max(col)-min(col)+1) <= 6*least(max(row)-min(row)+1, max(col)-min(col)+1)")
def r12_levelled(t: Tables) -> DataFrame:
    ch = R.changes(R.indices(pixels(t)))
    r = R.levelled_patches(ch, SIDE, SIDE)
    return r.select("site_id", "label", "pixels", rnd("mean_bsi_change", 8).alias("mean_bsi_change"))


def _skeleton_sql(src: str) -> str:
    parts, cur = [], src
    for i in range(SIDE // 2):
        parts += [_ero(cur, f"s{i}e", "square", 1), _dil(f"s{i}e", f"s{i}d", "square", 1),
                  f"s{i}b AS (SELECT site_id, row, col FROM {cur} EXCEPT SELECT site_id, row, col FROM s{i}d)"]
        cur = f"s{i}e"
    return ", ".join(parts) + ", sk AS (" + " UNION ".join(f"SELECT * FROM s{i}b" for i in range(SIDE // 2)) + ")"


_SK = f"WITH {_EW}, {_clean('m0', 'mc', 'square', 1, 1, False)}, {_skeleton_sql('mc')}"


@query("r13_skeleton", _SK + " SELECT site_id, row, col FROM sk")
def r13(t: Tables) -> DataFrame:
    return R.skeleton(R.open_close(earthwork(t)[0])).select("site_id", "row", "col")


@query("r13_line_measures", _SK + ", k AS (SELECT site_id, count(*) AS s FROM sk GROUP BY 1), m AS (SELECT site_id, count(*) AS c FROM mc GROUP BY 1) "
       "SELECT site_id, round(s*10*1.12::DOUBLE, 6) AS length_m, round(c*100/(s*10*1.12::DOUBLE), 6) AS width_m, round(least(s/sqrt(c)/5, 1), 6) AS length_confidence FROM m JOIN k USING (site_id)")
def r13_lines(t: Tables) -> DataFrame:
    r = R.line_measures(R.open_close(earthwork(t)[0]), factor=1.12)
    return r.select("site_id", *[rnd(c, 6).alias(c) for c in ("length_m", "width_m", "length_confidence")])


@query("r14_pond_area", _LAB.replace("HAVING count(*) >= 5", "") + _MET + ", b AS (SELECT site_id, arg_max((pixels, boundary), (pixels, -label)) AS x FROM mt GROUP BY 1) "
       "SELECT site_id, x[1] AS pixels, round(0.6::DOUBLE*least(4*pi()*x[1]/power(x[2], 2), 1) + 0.4::DOUBLE*least(x[1]/100.0::DOUBLE, 1), 6) AS confidence FROM b")
def r14(t: Tables) -> DataFrame:
    return R.pond_area(earthwork(t)[0]).select("site_id", "pixels", rnd("confidence", 6).alias("confidence"))


@query("r14_levelling_area", f"WITH {_EW} SELECT site_id, count(*) AS pixels, count(*)*100.0::DOUBLE AS area_sqm, round(least(count(*)/200.0::DOUBLE, 1), 6) AS confidence FROM m0 GROUP BY 1")
def r14_level(t: Tables) -> DataFrame:
    return R.levelling_area(earthwork(t)[0]).withColumn("confidence", rnd("confidence", 6))


@query("r15_band_signature", f"WITH {_EW} SELECT site_id, phase, round(avg(nir), 8) AS nir, round(avg(red), 8) AS red, round(avg(swir), 8) AS swir FROM px JOIN m0 USING (site_id, row, col) GROUP BY 1, 2")
def r15(t: Tables) -> DataFrame:
    s = R.band_signature(pixels(t), earthwork(t)[0], ("nir", "red", "swir"))
    return s.select("site_id", "phase", *[rnd(b, 8).alias(b) for b in ("nir", "red", "swir")])


def measures(t: Tables) -> DataFrame:
    """Line items as measures: ship modes are dimensions, discount moves the estimate."""
    li = t.lineitem
    return li.select(
        F.col("l_orderkey").alias("work_id"), F.concat(F.col("l_returnflag"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("dimension"),
        (F.col("l_quantity") * (1 - F.col("l_discount") * 5)).alias("estimated"),
        F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_quantity")).alias("reported"), F.col("l_tax").alias("confidence"),
    )


_MEAS = ("ms AS (SELECT l_orderkey AS work_id, l_returnflag || l_linenumber || '-' || l_partkey AS dimension, l_quantity*(1 - l_discount*5) AS estimated, CASE WHEN l_returnflag = 'N' THEN 0.0::DOUBLE ELSE l_quantity END AS reported, l_tax AS confidence FROM lineitem), "
         "dv AS (SELECT *, CASE WHEN reported > 0 THEN abs(estimated-reported)/reported*100 ELSE 0 END AS d FROM ms), "
         "ag AS (SELECT work_id, avg(confidence) AS c, max(estimated) AS m, avg(CASE WHEN reported > 0 THEN round(d, 9) END) AS md, count(*) AS n FROM dv GROUP BY 1), "
         "vd AS (SELECT *, CASE WHEN m <= 0 THEN 'not_detected' WHEN md IS NULL THEN 'partial_match' WHEN md <= 20.000001 THEN 'verified' WHEN md <= 40.000001 THEN 'partial_match' ELSE 'mismatch' END AS s FROM ag)")


@query("r16_work_verdict", f"WITH {_MEAS} SELECT work_id, round(c, 6) AS confidence, round(md, 6) AS mean_deviation_pct, s AS verification_status FROM vd")
def r16(t: Tables) -> DataFrame:
    v = R.work_verdict(measures(t), tolerance_pct=20.000001)
    return v.select("work_id", rnd("confidence", 6).alias("confidence"), rnd("mean_deviation_pct", 6).alias("mean_deviation_pct"), "verification_status")


SATELLITE_SCORE = "least((count(*) FILTER (WHERE s = 'mismatch' OR c < 0.02) + 0.5*count(*) FILTER (WHERE s = 'not_detected'))*1.0::DOUBLE/count(*), 1)"


@query("r18_satellite_score", f"WITH {_MEAS} SELECT work_id % 97 AS panchayat, round({SATELLITE_SCORE}, 6) AS satellite_score FROM vd GROUP BY 1")
def r18(t: Tables) -> DataFrame:
    v = R.work_verdict(measures(t), tolerance_pct=20.000001)
    v = v.select((F.col("work_id") % 97).alias("panchayat"), "verification_status", F.when(F.col("confidence") < 0.02, 0.1).otherwise(0.9).alias("confidence_score"))
    return R.satellite_score(v, ["panchayat"]).withColumn("satellite_score", rnd("satellite_score", 6))


@query("r17_measure_flags", f"WITH {_MEAS}, f AS (SELECT work_id, dimension, CASE WHEN reported <> 0 THEN 100*abs(estimated-reported)/abs(reported) WHEN estimated <> 0 THEN 100 ELSE 0 END AS p FROM ms) "
       "SELECT work_id, dimension, round(p, 6) AS pct_deviation, CASE WHEN p > 45 THEN 'CRITICAL' WHEN p > 22 THEN 'WARNING' ELSE 'OK' END AS flag FROM f")
def r17(t: Tables) -> DataFrame:
    m = measures(t)
    keys = ["work_id", "dimension", "confidence", "_key"]
    m = m.withColumn("_key", F.col("reported"))
    d = m.select(*keys, F.col("estimated").alias("detected"))
    r = joins.compare_measures(d, m.select(*keys, "reported"), keys, warn=22, crit=45)
    return r.select("work_id", "dimension", rnd("pct_deviation", 6).alias("pct_deviation"), "flag")


@query("r19_display_stretch", f"WITH {PIXELS}, dn AS (SELECT site_id, phase, round(nir*1000) AS v FROM px), q AS (SELECT site_id, phase, quantile_cont(v, 0.02) AS p2, quantile_cont(v, 0.98) AS p98 FROM dn GROUP BY 1, 2) "
       "SELECT site_id, phase, sum(CASE WHEN p98 <= p2 THEN 0 ELSE CAST(floor((least(greatest(v, p2), p98)-p2)/(p98-p2)*255) AS INTEGER) END)::BIGINT AS levels, count(*) AS pixels FROM dn JOIN q USING (site_id, phase) GROUP BY 1, 2")
def r19(t: Tables) -> DataFrame:
    s = R.display_stretch(pixels(t).withColumn("nir", F.round(F.col("nir") * 1000)), ["nir"])
    return s.groupBy("site_id", "phase").agg(F.sum("nir").alias("levels"), F.count(F.lit(1)).alias("pixels"))


@query("r20_comparison_rows", f"WITH {_MEAS} SELECT work_id, dimension, estimated, reported, round(d, 6) AS deviation_pct, s AS verification_status FROM dv JOIN vd USING (work_id)")
def r20(t: Tables) -> DataFrame:
    r = R.comparison_rows(measures(t), tolerance_pct=20.000001)
    return r.select("work_id", "dimension", "estimated", "reported", rnd("deviation_pct", 6).alias("deviation_pct"), "verification_status")
