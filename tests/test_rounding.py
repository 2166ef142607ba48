"""Last bits that decide: percentiles between two values."""

import duckdb
from pyspark.sql import functions as F

from tallyscope.operators import raster
from tallyscope.ordered import quantiles

# near infrared, in thousandths, of site 40 after the work
EDGE = [58, 60, 62, 67, 77, 77, 85, 85, 87, 88, 94, 95, 98, 99, 111, 115, 117, 129, 129, 143, 147, 180, 180, 183, 184, 184, 184, 185, 185, 186, 191,
    192, 194, 194, 195, 195, 196, 197, 197, 198, 198, 199, 201, 203, 207, 207, 208, 209, 210, 211, 211, 212, 212, 214, 216, 217, 217, 217, 218, 219,
    220, 220, 221, 223, 224, 226, 228, 229, 230, 230, 231, 231, 232, 234, 234, 235, 236, 239, 239, 241, 242, 243, 249, 249, 250, 250, 251, 252, 253,
    253, 253, 256, 258, 260, 260, 262, 262, 263, 264, 264, 264, 265, 266, 271, 272, 275, 276, 276, 277, 279, 400, 400, 401, 401, 401, 402, 403, 403,
    403, 404, 404, 404, 404, 404, 404, 405, 405, 405, 405, 406, 406, 407, 407, 407, 408, 408, 408, 408, 409, 409, 410, 410, 410, 410, 410, 411, 413,
    414, 415, 416, 417, 418, 418, 418, 418, 418, 420, 420, 420, 421, 421, 421, 422, 422, 422, 422, 422, 422, 422, 423, 423, 423, 423, 424, 425, 426,
    426, 426, 426, 427, 427, 427, 428, 428, 428, 429, 430, 430, 430, 430, 430, 430, 430, 431, 431, 431, 432, 432, 432, 432, 432, 432, 433, 433, 433,
    433, 434, 434, 434, 435, 435, 435, 435, 435, 435, 436, 436, 436, 437, 437, 438, 438, 438, 439, 439, 440, 440, 440, 441, 441, 442, 442, 442, 442,
    443, 443, 443, 443, 443, 444, 444, 445, 445, 445, 445, 445, 445, 445, 446, 446, 447, 447, 447, 447, 448, 448, 449, 449, 449, 450, 450, 450, 451,
    451, 451, 452, 452, 452, 452, 452, 453, 453, 454, 454, 454, 454, 454, 454, 454, 455, 455, 456, 456, 457, 458, 458, 458, 458, 459, 459, 460, 460,
    461, 462, 462, 462, 462, 463, 463, 463, 464, 464, 464, 465, 465, 466, 467, 467, 468, 468, 468, 468, 469, 470, 470, 470, 471, 471, 472, 472, 472,
    472, 473, 473, 474, 474, 474, 474, 475, 475, 475, 475, 475, 476, 476, 476, 477, 477, 478, 478, 478, 478, 479, 479, 479, 479, 480, 480, 480, 480,
    480, 480, 480, 481, 481, 482, 482, 483, 483, 484, 484, 485, 485, 485, 486, 488, 488, 489, 489, 490, 490, 490, 490, 490, 491, 491, 491, 491, 492,
    492, 493, 494, 494, 494, 495, 495, 495, 495, 496, 496, 496, 497, 497, 497, 497, 498, 498, 498, 499, 499]


def test_percentiles_equal_sql_to_the_last_bit(spark):
    rows = [(k, float((i * 7919 + k * 31) % 97 + 401)) for k in range(40) for i in range(300 + 7 * k)]
    df = spark.createDataFrame(rows, "k int, v double")
    pdf = df.toPandas()  # noqa: F841 - read by duckdb
    want = duckdb.sql("SELECT k, quantile_cont(v, 0.02), quantile_cont(v, 0.98) FROM pdf GROUP BY 1").fetchall()
    got = quantiles(df, ["k"], "v", {"a": 0.02, "b": 0.98}).select("k", "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stretch_of_a_pixel_on_the_edge_of_a_level(spark):
    # 86.96 is its 2nd percentile; one bit more puts the pixel at the edge a level lower
    rows = [("s", "after", float(v)) for v in EDGE]
    px = spark.createDataFrame(rows, "site_id string, phase string, nir double")
    pdf = px.toPandas()  # noqa: F841 - read by duckdb
    want = duckdb.sql(
        "WITH q AS (SELECT quantile_cont(nir, 0.02) AS a, quantile_cont(nir, 0.98) AS b FROM pdf) "
        "SELECT sum(floor((least(greatest(nir, a), b) - a) / (b - a) * 255)) FROM pdf, q"
    ).fetchall()[0][0]
    assert raster.display_stretch(px, ["nir"]).agg(F.sum("nir")).first()[0] == want
