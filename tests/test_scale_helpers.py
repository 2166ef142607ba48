"""The skew-proof building blocks against plain pandas and sequential code."""

import collections
import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyscope.operators import attendance, forest, graph, payments, raster, sequences, similarity
from tallyscope.ordered import quantiles, scan


def test_scan_with_a_hot_key(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.6, "hot", rng.integers(0, 50, 3000).astype(str)), "t": rng.integers(0, 500, 3000), "i": np.arange(3000), "v": rng.integers(-5, 9, 3000)})
    df = spark.createDataFrame(pdf)
    got = scan(df, ["k"], [F.col("t"), F.col("i")], F.floor(F.col("t") / 7), sums={"s": F.col("v")}, lags={"p": F.col("i")}, leads={"n": F.col("i")}, row_number="r").toPandas().sort_values("i")
    want = pdf.sort_values(["k", "t", "i"])
    g = want.groupby("k")
    want = want.assign(s=g.v.cumsum(), p=g.i.shift(1), n=g.i.shift(-1), r=g.cumcount() + 1).sort_values("i")
    for c in ("s", "p", "n", "r"):
        np.testing.assert_array_equal(got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy())


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 4, 2000), "v": np.round(rng.lognormal(3, 2, 2000) - 5, 2)})
    got = quantiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.98}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["a", "b", "c"]].to_numpy(float), np.percentile(g.v, [25, 50, 98]), rtol=1e-12)


def test_sessions_merge_at_the_limit(spark):
    rows = [("w", i, f"2024-01-01 00:{m:02d}:{s:02d}") for i, (m, s) in enumerate([(0, 0), (5, 0), (10, 1)])]
    df = spark.createDataFrame(rows, "w string, i int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted(r["rows"] for r in sequences.gap_sessions(df, ["w"], "ts", "i", 300).collect())
    assert got == [1, 2]


def sets_fixture(seed, n_sets, n_items, copies):
    rnd = random.Random(seed)
    base = [frozenset(rnd.sample(range(n_items), rnd.randint(8, 12))) for _ in range(n_sets)]
    out = []
    for b in base:
        for _ in range(rnd.randint(1, copies)):
            s = set(b)
            if rnd.random() < 0.5:
                s ^= {rnd.randrange(n_items)}
            out.append(frozenset(s))
    return dict(enumerate(out))


def jac(a, b):
    return len(a & b) / len(a | b)


def test_jaccard_pairs_expand_to_all_pairs(spark):
    sets = sets_fixture(3, 12, 25, 5)
    df = spark.createDataFrame([("s", m, i) for m, s in sets.items() for i in s], "scope string, m long, i long")
    _, member = similarity.set_classes(df, ["scope"], "m", "i")
    pairs = similarity.jaccard_pairs(df, ["scope"], "m", "i", 0.8)
    got = {tuple(sorted((r["member_a"], r["member_b"]))) for r in similarity.expand_pairs(pairs, member, ["scope"], "m").collect()}
    want = {(a, b) for a in sets for b in sets if a < b and jac(sets[a], sets[b]) >= 0.8 - 1e-12}
    assert got == want


def greedy(sets, order, t):
    taken, groups = set(), []
    for x, i in enumerate(order):
        if i in taken:
            continue
        g = [i] + [j for j in order[x + 1:] if j not in taken and jac(sets[i], sets[j]) >= t]
        if len(g) > 1:
            groups.append(g)
            taken.update(g)
    return groups


def test_clone_groups_follow_the_sequential_rule(spark):
    sets = sets_fixture(5, 10, 20, 6)
    rows = [("w", m, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime()) for m, s in sets.items() for i in s]
    df = spark.createDataFrame(rows, "work string, worker long, ts timestamp").withColumn("day", F.to_date("ts"))
    order = sorted(sets, key=lambda m: (min(sets[m]), m))
    want = greedy(sets, order, 0.8)
    got = attendance.clone_members(df, "work", "worker", "day", 0.8).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["leader"], set()).add(r["worker"])
    assert groups == {g[0]: set(g) for g in want}
    days = set().union(*sets.values())
    stats = {r["leader"]: (r["matching_days"], r["fake_person_days"]) for r in attendance.clone_groups(df, "work", "worker", "day", 0.8).collect()}
    for g in want:
        m = sum(1 for d in days if len({d in sets[i] for i in g}) == 1)
        assert stats[g[0]] == (m, m * (len(g) - 1))


def test_vendor_clusters_follow_the_sequential_rule(spark):
    sets = sets_fixture(7, 9, 14, 4)
    names = {m: random.Random(m).choice(["Ram Steel", "Ram Steel Co", "Sita Cement", "Gopal Sand"]) for m in sets}
    rates = {m: random.Random(m + 99).choice([90.0, 100.0, 140.0]) for m in sets}
    df = spark.createDataFrame([("d", m, i, names[m], rates[m], 10.0) for m, s in sets.items() for i in s], "d string, v long, gp long, name string, rate double, amount double")
    std = spark.createDataFrame([("d", 100.0)], "d string, rate double")

    def judged(g):
        all_rates = [rates[m] for m in g for _ in sets[m]]
        infl = (np.mean(all_rates) - 100) / 100 * 100
        common = set.intersection(*[set(sets[m]) for m in g])
        words = [set(names[m].lower().split()) - {"co"} for m in g]
        alike = any(len(a & b) / len(a | b) > 0.5 for i, a in enumerate(words) for b in words[i + 1:])
        return (["rate_inflation"] if infl > 25 else []) + (["shared_multiple_panchayats"] if len(common) >= 3 else []) + (["similar_vendor_names"] if alike else [])

    taken, want = set(), {}
    order = sorted(sets)
    for x, i in enumerate(order):
        if i in taken:
            continue
        g = [i] + [j for j in order[x + 1:] if j not in taken and jac(sets[i], sets[j]) >= 0.5 and len(sets[i] & sets[j]) >= 2]
        if len(g) > 1 and judged(g):
            want[i] = (len(g), judged(g))
            taken.update(g)
    got = payments.vendor_clusters(df, std, district="d", vendor="v", panchayat="gp", name="name", rate="rate", amount="amount")
    assert {r["leader"]: (r["vendors"], r["indicators"]) for r in got.collect()} == want


def test_hamming_pairs_are_complete(spark):
    rnd = random.Random(11)
    base = [rnd.getrandbits(64) for _ in range(20)]
    hashes = []
    for h in base:
        for d in (0, 5, 10, 11):
            x = h
            for bit in rnd.sample(range(64), d):
                x ^= 1 << bit
            hashes.append(x)
    rows = [(i, h - (1 << 64) if h >= 1 << 63 else h) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "i long, h long")
    got = {(r["a"], r["b"]): r["distance"] for r in similarity.hamming_pairs(df, [], "i", "h", 10).collect() if r["a"] != r["b"]}
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    reps = sorted(first.values())
    want = {(a, b): bin(hashes[a] ^ hashes[b]).count("1") for a in reps for b in reps if a < b and bin(hashes[a] ^ hashes[b]).count("1") <= 10}
    assert got == want
    pairs = similarity.hamming_pairs(df, [], "i", "h", 6, equal=2)
    assert pairs.count() == len({(r["a"], r["b"]) for r in pairs.collect()}) == sum(d <= 6 for d in want.values()) + sum(hashes.count(hashes[r]) > 1 for r in reps)


def test_hamming_work_grows_slowly(spark):
    """Keys and chance meetings of a random hash at distance 10, by the number of hashes in its scope."""
    sizes = [10**k for k in (3, 4, 5, 6, 7)]
    chosen = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").orderBy("n").select(similarity.slices_for(F.col("n"), 10)).collect()]
    work = []
    for n, e in zip(sizes, chosen):
        widths = [w for _, w in similarity._slices(10 + e)]
        work.append(sum(1 + n / 2 ** sum(c) for c in itertools.combinations(widths, e)))
    print(list(zip(sizes, chosen, map(round, work))))
    assert chosen == sorted(chosen) and chosen[0] < chosen[-1]
    # ten times the hashes never make five times the work of each
    assert all(b < 5 * a for a, b in zip(work, work[1:])) and work[3] < 6000


def test_hamming_pairs_of_scopes_of_all_sizes(spark):
    rnd = random.Random(7)
    rows = [(s, i, rnd.getrandbits(64)) for s, n in (("a", 5), ("b", 900), (None, 40)) for i in range(n)]
    rows += [(s, 10_000 + i, h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 12)))) for s, i, h in rows[::7]]
    df = spark.createDataFrame([(s, i, h - (1 << 64) if h >> 63 else h) for s, i, h in rows], "s string, i long, h long")
    got = [{tuple(r) for r in similarity.hamming_pairs(df.filter("s IS NOT NULL"), ["s"], "i", "h", 10, e).collect()} for e in (None, 3)]
    assert got[0] == got[1] and len(got[0]) > 90


def test_spread_of_a_crowded_day(spark):
    rng = np.random.default_rng(4)
    la, lo = rng.uniform(8, 34, 300), rng.uniform(70, 96, 300)
    df = spark.createDataFrame(pd.DataFrame({"w": "a", "la": la, "lo": lo}))
    r, p = np.radians(la), np.radians(lo)
    xyz = np.c_[np.cos(r) * np.cos(p), np.cos(r) * np.sin(p), np.sin(r)]
    want = 6371 * np.arccos(np.clip(xyz @ xyz.T, -1, 1)).max()
    got = attendance.max_spread(df, ["w"], "la", "lo", direct=10, chunk=50).first()["distance_km"]
    assert abs(got - want) < 1e-3


def test_components_across_tiles(spark):
    px = [("s", 5, c) for c in range(100, 300)] + [("s", r, 200) for r in range(5, 200)] + [("s", 150, 10), ("s", 150, 12)]
    mask = spark.createDataFrame(px, "site_id string, row int, col int").distinct().withColumn("height", F.lit(300)).withColumn("width", F.lit(300))
    sizes = sorted(r["count"] for r in raster.components(mask).groupBy("label").count().collect())
    assert sizes == [1, 1, 394]


def test_graph_components_and_communities(spark):
    edges = [(a, b, 1.0) for a in range(6) for b in range(a)] + [(a, b, 1.0) for a in range(10, 16) for b in range(10, a)]
    two = spark.createDataFrame(edges, "src long, dst long, amount double")
    comp = graph.connected_components(two.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    assert {r["v"]: r["component"] for r in comp.collect()} == {**{i: 0 for i in range(6)}, **{i: 10 for i in range(10, 16)}}
    one = spark.createDataFrame([*edges, (5, 10, 1.0)], "src long, dst long, amount double")
    got = {r["id"]: r["community"] for r in graph.communities(one).collect()}
    assert len(set(got.values())) == 2 and got[0] == got[5] and got[10] == got[15]


def test_eigenvector_matches_numpy(spark):
    e = [(0, 1), (0, 2), (0, 3), (1, 2), (3, 4)]
    a = np.zeros((5, 5))
    for i, j in e:
        a[i, j] = a[j, i] = 1
    w, v = np.linalg.eigh(a)
    want = np.abs(v[:, w.argmax()])
    got = graph.eigenvector(spark.createDataFrame(e, "src long, dst long")).orderBy("id").toPandas()["eigenvector"].to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-4)


def test_forest_finds_the_planted_row(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": np.arange(400), "a": rng.normal(0, 1, 400), "b": rng.normal(0, 1, 400)})
    pdf.loc[7, ["a", "b"]] = [40.0, -40.0]
    pdf.loc[9, "a"] = None
    got = forest.isolation_forest(spark.createDataFrame(pdf), "id", ["a", "b"], 0.05, trees=50, sample=64).toPandas()
    assert got.sort_values("anomaly_score")["id"].iloc[0] == 7
    assert 15 <= got["is_anomaly"].sum() <= 25
