"""Photo detectors over metadata and hash tables.

Each check returns ``work_id, photo_id, anomaly_type, severity, detail``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..plans.findings import union_all
from ..session import durable
from .sequences import close_pairs, gap_sessions, mode_per_group
from .similarity import hamming_pairs

# Names of editing programs, and those that lower an EXIF score.
EDITORS = (
    "photoshop", "gimp", "lightroom", "snapseed", "pixlr", "paint.net", "affinity", "canva", "fotor", "picsart",
)
EXIF_EDITORS = ("photoshop", "gimp", "lightroom", "paint")
EXIF_FIELDS = ("DateTime", "GPSInfo", "Make", "Model")


def _finding(df: DataFrame, kind: str, severity: Column | str, detail: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        "work_id", "photo_id", F.lit(kind).alias("anomaly_type"), sev.alias("severity"), detail.cast("string").alias("detail")
    )


def gps_mismatch(photos: DataFrame, sites: DataFrame, tolerance_m: float = 5000) -> DataFrame:
    """Photos taken further from their work than the tolerance; no position passes."""
    d = haversine_m(F.col("gps_lat"), F.col("gps_lon"), F.col("site_lat"), F.col("site_lon"))
    far = photos.filter(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()).join(sites, "work_id").withColumn("_d", d)
    return _finding(far.filter(F.col("_d") > tolerance_m), "gps_mismatch", "high", F.round("_d", 1))


def near_times(photos: DataFrame, within_seconds: float = 60) -> DataFrame:
    rows = photos.filter(F.col("capture_ts").isNotNull()).select("work_id", "photo_id", "capture_ts")
    pairs = close_pairs(rows, ["work_id"], "capture_ts", "photo_id", within_seconds)
    return _finding(pairs, "timestamp_duplicate", "medium", F.col("next_id"))


def stripped_exif(photos: DataFrame) -> DataFrame:
    gone = _finding(photos.filter(~F.col("has_exif")), "exif_stripped", "high", F.lit(None))
    cut = _finding(photos.filter(F.col("has_exif") & F.col("gps_lat").isNull()), "exif_tampered", "medium", F.lit(None))
    return gone.unionByName(cut)


def edited(photos: DataFrame) -> DataFrame:
    pattern = "|".join(e.replace(".", r"\.") for e in EDITORS)
    return _finding(photos.filter(F.lower("software").rlike(pattern)), "software_editing", "critical", F.col("software"))


def near_duplicates(photos: DataFrame, scope: Sequence[str] = ("work_id",), max_distance: int = 10, equal: int | None = None) -> DataFrame:
    """Near-equal pictures inside a scope (work or district), by 64-bit hash."""
    pairs = hamming_pairs(photos, list(scope), "photo_id", "phash", max_distance, equal)
    return pairs.withColumn("severity", F.when(F.col("distance") <= 5, "critical").otherwise("high"))


def reused_hashes(photos: DataFrame, hash_col: str = "phash") -> DataFrame:
    """Hashes seen in more than one work, with the number of works and photos."""
    known = photos.filter(F.col(hash_col).isNotNull())
    per_work = known.groupBy(hash_col, "work_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_work.groupBy(hash_col).agg(F.count(F.lit(1)).alias("works"), F.sum("_n").alias("photos")).filter("works > 1")


def cross_work_reuse(photos: DataFrame, hash_col: str = "phash") -> DataFrame:
    """Every photo whose hash also occurs in another work."""
    hot = reused_hashes(photos, hash_col)
    return _finding(photos.join(hot, hash_col), "image_duplicate", "critical", F.col("works"))


def bulk_uploads(photos: DataFrame, ts: str = "upload_ts", gap_seconds: int = 300, at_least: int = 5, fast: float = 10.0) -> DataFrame:
    """Upload bursts of a work; suspicious when the mean gap is under ``fast`` seconds."""
    sessions = gap_sessions(photos.filter(F.col(ts).isNotNull()), ["work_id"], ts, "photo_id", gap_seconds)
    return sessions.filter(F.col("rows") >= at_least).withColumn(
        "is_suspicious", F.coalesce(F.col("mean_gap_seconds"), F.lit(0.0)) < fast
    )


def camera_minority(photos: DataFrame, at_least: int = 3) -> DataFrame:
    """Photos of a work taken with another camera than its most frequent one."""
    cam = F.concat_ws("|", F.coalesce("camera_make", F.lit("")), F.coalesce("camera_model", F.lit("")))
    known = photos.filter((F.coalesce("camera_make", F.lit("")) != "") | (F.coalesce("camera_model", F.lit("")) != ""))
    known = known.select("work_id", "photo_id", cam.alias("camera"))
    usual = mode_per_group(known, ["work_id"], "camera", "photo_id").select("work_id", F.col("camera").alias("_usual"))
    enough = known.groupBy("work_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    odd = known.join(usual.join(enough, "work_id"), "work_id").filter(F.col("camera") != F.col("_usual"))
    return _finding(odd, "camera_inconsistency", "low", F.col("camera"))


def at_night(photos: DataFrame, start: str = "06:00:00", end: str = "18:30:00") -> DataFrame:
    clock = F.date_format("capture_ts", "HH:mm:ss.SSSSSS")
    out = photos.filter((clock < f"{start}.000000") | (clock > f"{end}.000000"))
    return _finding(out, "nighttime_photo", "medium", F.date_format("capture_ts", "HH:mm"))


def odd_resolution(photos: DataFrame) -> DataFrame:
    """Photos with under half or over twice the pixels of the usual size of the work."""
    known = photos.filter((F.col("image_width") > 0) & (F.col("image_height") > 0)).withColumn(
        "_size", F.struct(F.col("image_width").alias("w"), F.col("image_height").alias("h"))
    )
    usual = mode_per_group(known, ["work_id"], "_size", "photo_id").select(
        "work_id", (F.col("_size.w").cast("double") * F.col("_size.h")).alias("_usual")
    )
    ratio = F.col("image_width").cast("double") * F.col("image_height") / F.col("_usual")
    odd = known.join(usual, "work_id").withColumn("_r", ratio).filter((F.col("_r") < 0.5) | (F.col("_r") > 2))
    return _finding(odd, "resolution_anomaly", "low", F.round("_r", 2))


# -- integrity ----------------------------------------------------------------------

def exif_score(has_exif: Column, exif: Column) -> Column:
    """1 minus deductions for missing fields, differing times and editing software."""
    missing = F.lit(0)
    for f in EXIF_FIELDS:
        missing = missing + F.when(F.map_contains_key(exif, f), 0).otherwise(1)
    a, b = exif["DateTimeOriginal"], exif["DateTimeDigitized"]
    moved = F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))
    tool = F.coalesce(F.lower(exif["Software"]).rlike("|".join(EXIF_EDITORS)), F.lit(False))
    score = 1.0 - missing * 0.15 - F.when(moved, 0.2).otherwise(0.0) - F.when(tool, 0.3).otherwise(0.0)
    return F.when(has_exif, F.greatest(score, F.lit(0.0))).otherwise(0.3)


def size_score(quality: Column, size: Column, width: Column, height: Column) -> Column:
    """Agreement of the file size with what quality and pixels suggest."""
    pixels = width.cast("double") * height
    ratio = size / (pixels * (0.5 + quality / 100.0 * 2.0) / 8.0)
    return (
        F.when(pixels == 0, 0.5).when((ratio > 0.5) & (ratio < 2.0), 0.9).when((ratio > 0.3) & (ratio < 3.0), 0.6).otherwise(0.3)
    )


def quantisation_score(tables: Column) -> Column:
    """Variance class of the first non-empty quantisation table."""
    first = F.get(F.filter(tables, lambda q: F.size(q) > 0), F.lit(0))
    n = F.size(first)
    mean = F.aggregate(first, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(first, F.lit(0.0), lambda s, x: s + F.pow(x - mean, F.lit(2))) / n
    return F.when(first.isNull(), 0.7).when(var < 10, 0.5).when(var > 500, 0.6).otherwise(0.9)


def thumbnail_score(has: Column, matches: Column) -> Column:
    return F.when(~F.coalesce(has, F.lit(False)), 0.8).when(F.coalesce(matches, F.lit(True)), 1.0).otherwise(0.3)


def integrity(photos: DataFrame) -> DataFrame:
    """Mean of the four integrity scores per photo."""
    parts = {
        "exif_score": exif_score(F.col("has_exif"), F.col("exif_data")),
        "size_score": size_score(F.col("jpeg_quality"), F.col("file_size_bytes"), F.col("image_width"), F.col("image_height")),
        "quantisation_score": quantisation_score(F.col("quantization_tables")),
        "thumbnail_score": thumbnail_score(F.col("has_thumbnail"), F.col("thumbnail_matches_main")),
    }
    total = F.lit(0.0)
    for name in parts:
        total = total + F.col(name)
    return photos.select("work_id", "photo_id", *[c.alias(n) for n, c in parts.items()]).withColumn("integrity_score", total / 4)


# -- verdicts -------------------------------------------------------------------------

def verdicts(issues: DataFrame) -> DataFrame:
    """Status per photo from its boolean issues: several, else the most serious one."""
    order = {
        "gps_mismatch": "gps_mismatch", "is_duplicate": "duplicate", "type_mismatch": "type_mismatch",
        "is_manipulated": "manipulated", "is_stripped": "metadata_stripped",
    }
    n = F.lit(0)
    for c in order:
        n = n + F.coalesce(F.col(c), F.lit(False)).cast("int")
    status = F.when(n >= 2, "multiple_issues")
    for c, name in order.items():
        status = status.when(F.coalesce(F.col(c), F.lit(False)), name)
    return issues.withColumn("issues", n).withColumn("status", status.otherwise("verified"))


def work_verdicts(judged: DataFrame) -> DataFrame:
    """Photos, verified photos and their share per work."""
    return judged.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("photos"), F.count_if(F.col("status") == "verified").alias("verified")
    ).withColumn("confidence", F.col("verified") / F.col("photos"))


def photo_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted share of photos with each flag, doubled, at most 1."""
    def share(c: str) -> Column:
        return F.count_if(F.col(c)) / F.count(F.lit(1))

    score = 0.3 * share("gps_mismatch") + 0.3 * share("is_duplicate") + 0.25 * share("type_mismatch") + 0.15 * share("bulk_upload_flag")
    return df.groupBy(*keys).agg(F.least(score * 2, F.lit(1.0)).alias("photo_score"))


# -- content labels ---------------------------------------------------------------------

def label_centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean vector per label, added up position by position."""
    flat = df.select(label, F.posexplode(vec).alias("_p", "_x"))
    means = flat.groupBy(label, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_v")).select(
        label, F.transform("_v", lambda x: x["_m"]).alias("vec")
    )


def zero_shot(df: DataFrame, vec: str, labels: DataFrame, block: int = 256, spread: int = 256) -> DataFrame:
    """Most similar label of each vector and its softmax share; ties go to the first label.

    ``labels`` (``label, vec``) is dealt into blocks of about ``block``; each row meets
    each block once. A block stands ``spread`` times, and a hash of the vector says with
    which of them a row is joined, so no task has all rows of a block. With one block a row is done there; with more, rows are written
    with a number first and their best and sums are combined by it. Both ways give
    the same numbers for any count of labels.
    """

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))

    blocks = max(1, -(-labels.count() // block))
    named = labels.select("label", F.transform("vec", lambda e: e.cast("double")).alias("v")).withColumn("n", norm(F.col("v")))
    unit = F.transform("v", lambda e: e / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0))
    dealt = named.select("label", unit.alias("v"), F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("_b"))
    known = dealt.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("label", "v"))).alias("_known"))  # about ``block`` labels
    rows = df if blocks == 1 else durable(df.withColumn("_row", F.monotonically_increasing_id()))
    known = known.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    met = rows.withColumn("_at", F.pmod(F.xxhash64(vec), F.lit(spread).cast("long"))).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = met.join(known, ["_b", "_at"]).drop("_b", "_at")
    met = met.withColumn("_x", F.transform(F.col(vec), lambda e: e.cast("double"))).withColumn("_norm", norm(F.col("_x")))

    def dot(v: Column) -> Column:
        return F.aggregate(F.zip_with(F.col("_x"), v, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e) / F.col("_norm")

    sims = F.transform("_known", lambda k: F.struct(k["label"].alias("label"), dot(k["v"]).alias("sim")))
    met = met.withColumn("_sims", sims).drop("_known", "_x", "_norm")
    best = F.aggregate(F.slice("_sims", 2, 1 << 30), F.col("_sims")[0], lambda a, s: F.when(s["sim"] > a["sim"], s).otherwise(a))
    # similarities are cosines, so their exponentials need no shift
    met = met.withColumn("_best", best).withColumn("_total", F.aggregate("_sims", F.lit(0.0), lambda a, s: a + F.exp(s["sim"]))).drop("_sims")
    if blocks > 1:
        worse = F.struct(-F.col("_best")["sim"], F.col("_best")["label"])
        joined = met.groupBy("_row").agg(F.min_by("_best", worse).alias("_best"), F.sum("_total").alias("_total"))
        met = rows.join(joined, "_row").drop("_row")
    return (
        met.withColumn("predicted", F.col("_best")["label"]).withColumn("similarity", F.col("_best")["sim"])
        .withColumn("confidence", F.exp(F.col("_best")["sim"]) / F.col("_total")).drop("_best", "_total")
    )


# -- everything ---------------------------------------------------------------------------

def all_checks(photos: DataFrame, sites: DataFrame, hash_distance: int = 10) -> DataFrame:
    """Findings of every check over all works in one table."""
    dup = near_duplicates(photos, ("work_id",), hash_distance)
    return union_all([
        gps_mismatch(photos, sites), near_times(photos), stripped_exif(photos), edited(photos),
        dup.select(
            "work_id", F.col("a").alias("photo_id"), F.lit("image_duplicate").alias("anomaly_type"), "severity",
            F.col("b").cast("string").alias("detail"),
        ),
        cross_work_reuse(photos), camera_minority(photos), at_night(photos), odd_resolution(photos),
    ])


def per_work(findings: DataFrame, photos: DataFrame) -> DataFrame:
    """Photo, anomaly and critical counts of every work."""
    counts = findings.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("anomalies"), F.count_if(F.col("severity") == "critical").alias("critical")
    )
    total = photos.groupBy("work_id").agg(F.count(F.lit(1)).alias("photos"))
    return total.join(counts, "work_id", "left").fillna(0, ["anomalies", "critical"])
