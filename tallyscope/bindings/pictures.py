"""Photo detectors: events as photos of a user's work, embeddings as picture hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import photos as P
from .base import Tables, query, rnd
from .joins import HASH, order_hashes
from .scalars import spot, spot_sql


def photo_table(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    la, lo = spot("user_id", 7919, 104729)
    e = t.events.withColumn("k", k)
    exif = F.map_filter(
        F.create_map(
            F.lit("DateTime"), F.when(F.col("k") % 4 != 0, "x"), F.lit("GPSInfo"), F.when(F.col("k") % 3 != 0, "x"),
            F.lit("Make"), F.lit("m"), F.lit("DateTimeOriginal"), F.lit("a"), F.lit("DateTimeDigitized"), F.when(F.col("k") > 50, "a").otherwise("b"),
            F.lit("Software"), F.when(F.col("k") % 11 == 5, "GIMP 2").otherwise("cam"),
        ), lambda _, v: v.isNotNull(),
    )
    has_gps = F.col("k") % 10 != 9
    return e.select(
        F.col("event_id").alias("photo_id"), F.col("user_id").alias("work_id"), F.col("ts").alias("capture_ts"), F.col("ts").alias("upload_ts"),
        F.when(has_gps, la + F.col("k") * 0.001).alias("gps_lat"), F.when(has_gps, lo).alias("gps_lon"),
        (F.col("k") % 17 != 0).alias("has_exif"), exif.alias("exif_data"),
        F.when(F.col("k") == 5, "Adobe Photoshop 22").when(F.col("k") == 6, "Paint.NET").otherwise("Camera").alias("software"),
        F.concat(F.lit("M"), (F.col("k") % 3).cast("string")).alias("camera_make"), F.col("event_type").alias("camera_model"),
        (1000 + F.col("k") % 4 * 1000).alias("image_width"), F.lit(800).alias("image_height"), (60 + F.col("k") % 40).alias("jpeg_quality"),
        (F.col("value") * 10000).alias("file_size_bytes"), (F.col("k") % 2 == 0).alias("has_thumbnail"), (F.col("k") % 5 != 0).alias("thumbnail_matches_main"),
        F.when(F.col("k") % 7 != 0, F.array(F.array(F.lit(1), F.col("k"), F.col("k") * 2))).otherwise(F.array().cast("array<array<int>>")).alias("quantization_tables"),
        F.substring(F.md5(F.concat_ws(":", (F.col("event_id") % 3000).cast("string"), F.col("k").cast("string"))), 1, 16).alias("phash_hex"),
        F.col("k"),
    )


def site_table(t: Tables) -> DataFrame:
    la, lo = spot("work_id", 7919, 104729)
    works = t.events.select(F.col("user_id").alias("work_id")).distinct()
    return works.select("work_id", la.alias("site_lat"), lo.alias("site_lon"))


PHOTOS = """
    photos AS (SELECT event_id AS photo_id, user_id AS work_id, ts, value, CAST(props::JSON->>'k' AS INTEGER) AS k, event_type,
        substr(md5((event_id % 3000) || ':' || CAST(props::JSON->>'k' AS INTEGER)), 1, 16) AS phash_hex FROM events)
"""
_LA, _ = spot_sql("work_id", 7919, 104729)
# photos lie on the meridian of their site, so the distance is the latitude difference
_DIST = f"abs(radians({_LA} + k*0.001::DOUBLE) - radians({_LA}))*6371000"


@query("p1_gps_mismatch", f"WITH {PHOTOS} SELECT work_id, photo_id, round(round({_DIST}, 1)/1000, 3) AS detail_km FROM photos WHERE k % 10 <> 9 AND {_DIST} > 5000")
def p1(t: Tables) -> DataFrame:
    r = P.gps_mismatch(photo_table(t), site_table(t), 5000)
    return r.select("work_id", "photo_id", rnd(F.round(F.col("detail").cast("double"), 1) / 1000, 3).alias("detail_km"))


@query("p2_near_duplicates", f"WITH {HASH}, f AS (SELECT scope, h, min(id) AS rep, count(*) AS members FROM h GROUP BY 1, 2), "
       "p AS (SELECT a.scope AS work_id, a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM f a JOIN f b ON a.scope = b.scope AND (a.rep < b.rep OR (a.rep = b.rep AND a.members > 1))) "
       "SELECT *, CASE WHEN distance <= 5 THEN 'critical' ELSE 'high' END AS severity FROM p WHERE distance <= 10")
def p2(t: Tables) -> DataFrame:
    rows = order_hashes(t).select(F.col("scope").alias("work_id"), F.col("o_orderkey").alias("photo_id"), F.col("h64").alias("phash"))
    return P.near_duplicates(rows).drop("members_a", "members_b")


@query("p3_reused_hashes", f"WITH {PHOTOS} SELECT phash_hex, count(DISTINCT work_id) AS works, count(*) AS photos FROM photos GROUP BY 1 HAVING count(DISTINCT work_id) > 1")
def p3(t: Tables) -> DataFrame:
    return P.reused_hashes(photo_table(t), "phash_hex")


_BURST = f"""
    WITH {PHOTOS}, o AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY work_id ORDER BY ts, photo_id) AS g FROM photos),
    s AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY work_id ORDER BY ts, photo_id) AS s FROM o),
    b AS (SELECT work_id, s, count(*) AS rows, (max(us) - min(us))/1e6 AS d FROM s GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT work_id, CAST(s AS BIGINT) AS session, rows, round(d, 3) AS span_seconds, d/(rows-1) < 3600 AS is_suspicious FROM b
"""


@query("p4_bulk_uploads", _BURST)
def p4(t: Tables) -> DataFrame:
    r = P.bulk_uploads(photo_table(t), gap_seconds=14_400, at_least=3, fast=3600)
    return r.select("work_id", "session", "rows", rnd("span_seconds", 3).alias("span_seconds"), "is_suspicious")


@query("p5_near_times", f"WITH {PHOTOS}, o AS (SELECT work_id, photo_id, lead(photo_id) OVER w AS n, lead(epoch_us(ts)) OVER w - epoch_us(ts) AS g FROM photos WINDOW w AS (PARTITION BY work_id ORDER BY ts, photo_id)) "
       "SELECT work_id, photo_id, CAST(n AS VARCHAR) AS detail FROM o WHERE g < 900000000")
def p5(t: Tables) -> DataFrame:
    return P.near_times(photo_table(t), 900).select("work_id", "photo_id", "detail")


@query("p6_stripped_exif", f"WITH {PHOTOS} SELECT work_id, photo_id, CASE WHEN k % 17 = 0 THEN 'exif_stripped' ELSE 'exif_tampered' END AS anomaly_type FROM photos WHERE k % 17 = 0 OR k % 10 = 9")
def p6(t: Tables) -> DataFrame:
    return P.stripped_exif(photo_table(t)).select("work_id", "photo_id", "anomaly_type")


@query("p7_editing_software", f"WITH {PHOTOS} SELECT work_id, photo_id, CASE k WHEN 5 THEN 'Adobe Photoshop 22' ELSE 'Paint.NET' END AS detail FROM photos WHERE k IN (5, 6)")
def p7(t: Tables) -> DataFrame:
    return P.edited(photo_table(t)).select("work_id", "photo_id", "detail")


_CAM = "cam AS (SELECT work_id, photo_id, 'M' || (k % 3) || '|' || event_type AS camera FROM photos), cc AS (SELECT work_id, camera, count(*) AS n, min(photo_id) AS f FROM cam GROUP BY 1, 2), cm AS (SELECT work_id, arg_min(camera, (-n, f)) AS usual, sum(n) AS tot FROM cc GROUP BY 1)"


@query("p8_camera_minority", f"WITH {PHOTOS}, {_CAM} SELECT work_id, photo_id, camera AS detail FROM cam JOIN cm USING (work_id) WHERE camera <> usual AND tot >= 3")
def p8(t: Tables) -> DataFrame:
    return P.camera_minority(photo_table(t)).select("work_id", "photo_id", "detail")


@query("p9_at_night", f"WITH {PHOTOS} SELECT work_id, photo_id, strftime(ts, '%H:%M') AS detail FROM photos WHERE CAST(ts AS TIME) < TIME '06:00:00' OR CAST(ts AS TIME) > TIME '18:30:00'")
def p9(t: Tables) -> DataFrame:
    return P.at_night(photo_table(t)).select("work_id", "photo_id", "detail")


_RES = "rs AS (SELECT work_id, k % 4 AS c, count(*) AS n, min(photo_id) AS f FROM photos GROUP BY 1, 2), rm AS (SELECT work_id, arg_min(c, (-n, f)) AS c FROM rs GROUP BY 1)"
_RATIO = "(1 + k % 4)*1.0::DOUBLE/(1 + rm.c)"


@query("p10_odd_resolution", f"WITH {PHOTOS}, {_RES} SELECT photos.work_id, photo_id, round({_RATIO}, 2) AS ratio FROM photos JOIN rm ON rm.work_id = photos.work_id WHERE {_RATIO} < 0.5 OR {_RATIO} > 2")
def p10(t: Tables) -> DataFrame:
    return P.odd_resolution(photo_table(t)).select("work_id", "photo_id", F.col("detail").cast("double").alias("ratio"))


_EXIF = ("CASE WHEN k % 17 = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE - ((k % 4 = 0)::INT + (k % 3 = 0)::INT + 1)*0.15::DOUBLE - CASE WHEN k > 50 THEN 0.0 ELSE 0.2::DOUBLE END - CASE WHEN k % 11 = 5 THEN 0.3::DOUBLE ELSE 0.0 END END")
_SZ = "(value*10000)/((1000 + k % 4*1000)*800.0::DOUBLE*(0.5 + (60 + k % 40)/100.0::DOUBLE*2)/8)"
_SIZE = f"CASE WHEN {_SZ} > 0.5 AND {_SZ} < 2 THEN 0.9::DOUBLE WHEN {_SZ} > 0.3 AND {_SZ} < 3 THEN 0.6 ELSE 0.3 END"
_VAR = "((1.0::DOUBLE + k*k + 4*k*k)/3 - power((1.0::DOUBLE + 3*k)/3, 2))"
_QUANT = f"CASE WHEN k % 7 = 0 THEN 0.7::DOUBLE WHEN {_VAR} < 10 THEN 0.5 WHEN {_VAR} > 500 THEN 0.6 ELSE 0.9 END"
_THUMB = "CASE WHEN k % 2 <> 0 THEN 0.8::DOUBLE WHEN k % 5 <> 0 THEN 1.0 ELSE 0.3 END"


@query("p11_integrity", f"WITH {PHOTOS} SELECT photo_id, round({_EXIF}, 6) AS exif_score, {_SIZE} AS size_score, {_QUANT} AS quantisation_score, {_THUMB} AS thumbnail_score, "
       f"round((({_EXIF}) + ({_SIZE}) + ({_QUANT}) + ({_THUMB}))/4, 6) AS integrity_score FROM photos")
def p11(t: Tables) -> DataFrame:
    r = P.integrity(photo_table(t))
    return r.select("photo_id", rnd("exif_score", 6).alias("exif_score"), "size_score", "quantisation_score", "thumbnail_score", rnd("integrity_score", 6).alias("integrity_score"))


def issue_table(t: Tables) -> DataFrame:
    k = F.col("k")
    return photo_table(t).select(
        "work_id", "photo_id", (k % 7 == 0).alias("gps_mismatch"), (k % 11 == 0).alias("is_duplicate"), (k % 13 == 0).alias("type_mismatch"),
        (k % 17 == 0).alias("is_manipulated"), (k % 19 == 0).alias("is_stripped"), (k % 5 == 0).alias("bulk_upload_flag"),
    )


_VERDICT = ("CASE WHEN (k%7=0)::INT + (k%11=0)::INT + (k%13=0)::INT + (k%17=0)::INT + (k%19=0)::INT >= 2 THEN 'multiple_issues' WHEN k%7=0 THEN 'gps_mismatch' WHEN k%11=0 THEN 'duplicate' "
            "WHEN k%13=0 THEN 'type_mismatch' WHEN k%17=0 THEN 'manipulated' WHEN k%19=0 THEN 'metadata_stripped' ELSE 'verified' END")


@query("p12_verdicts", f"WITH {PHOTOS} SELECT work_id, photo_id, {_VERDICT} AS status FROM photos")
def p12(t: Tables) -> DataFrame:
    return P.verdicts(issue_table(t)).select("work_id", "photo_id", "status")


@query("p12_work_verdicts", f"WITH {PHOTOS}, v AS (SELECT work_id, {_VERDICT} AS status FROM photos) SELECT work_id, count(*) AS photos, count(*) FILTER (WHERE status = 'verified') AS verified, "
       "round(count(*) FILTER (WHERE status = 'verified')*1.0::DOUBLE/count(*), 6) AS confidence FROM v GROUP BY 1")
def p12_works(t: Tables) -> DataFrame:
    return P.work_verdicts(P.verdicts(issue_table(t))).withColumn("confidence", rnd("confidence", 6))


@query("p13_zero_shot_labels", """
    WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
    c AS (SELECT label, p, avg(x) AS m FROM f GROUP BY 1, 2), cn AS (SELECT label, sqrt(sum(m*m)) AS n FROM c GROUP BY 1), vn AS (SELECT vec_id, sqrt(sum(x*x)) AS n FROM f GROUP BY 1),
    s AS (SELECT f.vec_id, c.label, sum(x*m)/any_value(vn.n)/any_value(cn.n) AS sim FROM f JOIN c ON f.p = c.p JOIN cn ON cn.label = c.label JOIN vn ON vn.vec_id = f.vec_id GROUP BY 1, 2)
    SELECT vec_id, arg_max(label, sim) AS predicted, round(max(sim), 8) AS similarity, round(exp(max(sim))/sum(exp(sim)), 8) AS confidence FROM s GROUP BY 1
    """)
def p13(t: Tables) -> DataFrame:
    cent = P.label_centroids(t.embeddings, "label", "embedding")
    r = P.zero_shot(t.embeddings, "embedding", cent)
    return r.select("vec_id", "predicted", rnd("similarity", 8).alias("similarity"), rnd("confidence", 8).alias("confidence"))


PHOTO_SCORE = "least(2*(0.3::DOUBLE*avg((k%7=0)::INT) + 0.3::DOUBLE*avg((k%11=0)::INT) + 0.25::DOUBLE*avg((k%13=0)::INT) + 0.15::DOUBLE*avg((k%5=0)::INT)), 1)"


@query("p14_photo_score", f"WITH {PHOTOS} SELECT work_id, round({PHOTO_SCORE}, 8) AS photo_score FROM photos GROUP BY 1")
def p14(t: Tables) -> DataFrame:
    return P.photo_score(issue_table(t), ["work_id"]).withColumn("photo_score", rnd("photo_score", 8))


@query("p15_all_checks_per_work", f"""
    WITH {PHOTOS}, {_CAM}, {_RES},
    sg AS (SELECT work_id, photo_id, CAST('0x' || phash_hex AS UBIGINT)::HUGEINT AS h FROM photos), fo AS (SELECT work_id, h, min(photo_id) AS rep, count(*) AS n FROM sg GROUP BY 1, 2),
    o AS (SELECT work_id, lead(epoch_us(ts)) OVER (PARTITION BY work_id ORDER BY ts, photo_id) - epoch_us(ts) AS g FROM photos),
    re AS (SELECT phash_hex FROM photos GROUP BY 1 HAVING count(DISTINCT work_id) > 1),
    u AS (SELECT work_id, 'h' AS s FROM photos WHERE k % 10 <> 9 AND {_DIST} > 5000 UNION ALL SELECT work_id, 'm' FROM o WHERE g < 60000000
      UNION ALL SELECT work_id, 'h' FROM photos WHERE k % 17 = 0 OR k % 10 = 9 UNION ALL SELECT work_id, 'critical' FROM photos WHERE k IN (5, 6)
      UNION ALL SELECT a.work_id, CASE WHEN bit_count(xor(a.h, b.h)) <= 5 THEN 'critical' ELSE 'h' END FROM fo a JOIN fo b ON a.work_id = b.work_id AND (a.rep < b.rep OR (a.rep = b.rep AND a.n > 1)) AND bit_count(xor(a.h, b.h)) <= 10
      UNION ALL SELECT work_id, 'critical' FROM photos JOIN re USING (phash_hex) UNION ALL SELECT work_id, 'l' FROM cam JOIN cm USING (work_id) WHERE camera <> usual AND tot >= 3
      UNION ALL SELECT work_id, 'm' FROM photos WHERE CAST(ts AS TIME) < TIME '06:00:00' OR CAST(ts AS TIME) > TIME '18:30:00'
      UNION ALL SELECT photos.work_id, 'l' FROM photos JOIN rm ON rm.work_id = photos.work_id WHERE {_RATIO} < 0.5 OR {_RATIO} > 2)
    SELECT p.work_id, photos, coalesce(anomalies, 0) AS anomalies, coalesce(critical, 0) AS critical FROM (SELECT work_id, count(*) AS photos FROM photos GROUP BY 1) p
    LEFT JOIN (SELECT work_id, count(*) AS anomalies, count(*) FILTER (WHERE s = 'critical') AS critical FROM u GROUP BY 1) c ON c.work_id = p.work_id
    """)
def p15(t: Tables) -> DataFrame:
    photos = photo_table(t).withColumn("phash", F.conv("phash_hex", 16, -10).cast("bigint"))
    return P.per_work(P.all_checks(photos, site_table(t)), photos)
