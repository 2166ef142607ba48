"""Hashes that share a key by the hundred are compared tile by tile."""

import random

from pyspark.sql import functions as F

from tallyscope.operators import photos, similarity


def test_tiles_of_a_crowded_key(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    hashes = sorted({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9))) for _ in range(250)})
    rows = [(s, f"m{i:03}", h - (1 << 64) if h >> 63 else h) for s in ("x", None) for i, h in enumerate(hashes)]
    folded = spark.createDataFrame(rows, "s string, rep string, h long").withColumn("members", F.lit(1).cast("long"))
    got = similarity._hamming_by(folded, ["s"], 10, 2, tile=20).collect()
    want = {(f"m{i:03}", f"m{j:03}", (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 10}
    assert {(r["a"], r["b"], r["distance"]) for r in got} == want and len(got) == len(want) > 1000
    assert {r["s"] for r in got} == {"x"}


def test_a_key_costs_thousands_of_comparisons(spark):
    """Keys are shuffled, comparisons are not: 150,000 hashes take 11 keys each, not 286."""
    n = spark.createDataFrame([(150_000,)], "n long")
    assert n.select(similarity.slices_for(F.col("n"), 10, similarity._KEY_COST)).first()[0] == 1


def test_near_duplicates_of_a_crowded_work(spark):
    """Copies fold, pairs keep their work, and work without an id pairs nothing."""
    rows = [(w, i + 100 * n, (1 << (i % 12)) - 1) for n, w in enumerate(("a", "b", None)) for i in range(24)]
    got = photos.near_duplicates(spark.createDataFrame(rows, "work_id string, photo_id long, phash long")).collect()
    want = {(w, i + 100 * n, j + 100 * n, j - i) for n, w in enumerate("ab") for i in range(12) for j in range(i, 12) if j - i <= 10}
    assert {(r["work_id"], r["a"], r["b"], r["distance"]) for r in got if r["work_id"]} == want
    assert all(r["a"] == r["b"] for r in got if r["work_id"] is None)
