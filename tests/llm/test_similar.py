"""Line dedup, n-gram Jaccard join and the pipeline against brute force."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from tallyscope.llm import jaccard_join, line_dedup, pairing

POOL = [f"w{i}" for i in range(400)]


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def corpus(seed, n=60, group=40):
    """Random texts, copies, near copies in groups of up to ``group``, short and empty ones."""
    rng = random.Random(seed)
    xs = []
    for i in range(n):
        words = [rng.choice(POOL) for _ in range(rng.randint(3, 120))]
        xs.append(" ".join(words))
        for _ in range(group if i == 0 else rng.choice([0, 0, 1, 3])):
            near = list(words)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(POOL)
            xs.append(" ".join(near))
    xs += ["", None, "one", "one", "one two", " ", xs[0], xs[0]]
    rng.shuffle(xs)
    return xs


def brute_join(xs, n=5, threshold=0.8):
    items: dict[str, int] = {}
    for i, x in enumerate(xs):
        items.setdefault(x or "", i)
    texts = list(items)
    sets = [{tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if (w := x.split()) else set() for x in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
    links = collections.Counter(x for p in pairs for x in p)
    root = roots(len(texts), pairs)
    place = {t: k for k, t in enumerate(texts)}
    least: dict[int, int] = {}
    for t, i in items.items():
        least[root[place[t]]] = min(least.get(root[place[t]], i), i)
    return {i: (least[root[place[x or ""]]], links[place[x or ""]]) for i, x in enumerate(xs)}


@pytest.mark.parametrize("tile", [256, 8])
def test_join_matches_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(pairing, "TILE", tile)
    xs = corpus(1)
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(xs)] + [(None, xs[0], "")], "doc_id long, text string, sign string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(df).collect()}
    assert got == brute_join(xs)


def test_join_without_rows_or_links(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(df).collect())) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_pruning_keeps_the_likely():
    table = pairing.least_matches(128, 32, 0.8, 1e-6)
    assert [n for n, _ in table] == [32, 64, 96, 128]
    assert all(0 < m / n < 0.8 for n, m in table) and table[-1][1] / 128 > table[0][1] / 32
    rng = np.random.default_rng(1)
    # pairs of similarity 0.8 pass, of 0.3 don't
    ok = [np.all([rng.binomial(n, 0.8) >= m for n, m in table]) for _ in range(2000)]
    assert np.mean(ok) > 0.999
    assert rng.binomial(128, 0.3, 2000).max() < table[-1][1]


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b = base[:600], base[150:750]
    signs = pairing.minhash(np.concatenate([a, b]), np.array([0, 600]), 512)
    assert abs((signs[0] == signs[1]).mean() - 450 / 750) < 0.08


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(90)] + [(7, 7)]
    got = {r.id: r.component for r in pairing.components(spark.createDataFrame(edges, "id long, root long")).collect()}
    names = sorted({x for e in edges for x in e})
    place = {x: k for k, x in enumerate(names)}
    root = roots(len(names), [(place[a], place[b]) for a, b in edges])
    assert got == {x: names[root[place[x]]] for x in names if x != 7 and any(x in e and e[0] != e[1] for e in edges)}


def lines_corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(POOL) for _ in range(rng.randint(1, 25))) for _ in range(80)] + ["", " ", "ab", "ab ", "é" * 9]
    xs = [None, ""]
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 12)):
            x = rng.choice(pool)
            if x.strip() and rng.random() < 0.4:
                at = rng.randrange(len(x))
                x = x[:at] + rng.choice("xyz") + x[at + 1 :]
            lines.append(x)
        xs.append("\n".join(lines))
    return xs


def brute_lines(xs, n=7, threshold=0.8):
    where = collections.defaultdict(list)
    for i, x in enumerate(xs):
        for k, line in enumerate((x or "").split("\n")):
            if line.strip("\t\n\v\f\r "):
                where[line].append((i, k))
    lines = list(where)
    sets = [{x[k : k + n] for k in range(len(x) - n + 1)} for x in lines]
    similarity = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(lines)) for b in range(a) if sets[a] and sets[b]}
    root = roots(len(lines), [p for p, s in similarity.items() if s >= threshold])
    first: dict[int, tuple] = {}
    for k, x in enumerate(lines):
        first[root[k]] = min(first.get(root[k], (1 << 60, 0)), min(where[x]))
    gone = collections.defaultdict(set)
    for k, x in enumerate(lines):
        for i, line in where[x]:
            if (i, line) != first[root[k]]:
                gone[i].add(line)
    return {i: sorted(x) for i, x in gone.items()}


def test_lines_match_brute_force(spark):
    xs = lines_corpus(1)
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(xs)] + [(None, xs[5], "")], "doc_id long, text string, removed string")
    # with so many bands no pair of the threshold is missed
    gone = line_dedup.decisions(df, bands=30).cache()
    want = brute_lines(xs)
    assert {r.id: r.removed for r in gone.collect()} == want
    out = {r.doc_id: r.text for r in line_dedup.apply(df, gone).collect()}
    for i, x in enumerate(xs):
        left = "\n".join(y for k, y in enumerate((x or "").split("\n")) if k not in want.get(i, []))
        if i not in want:
            assert out[i] == x
        else:
            assert out.get(i, "") == (left if left.strip("\t\n\v\f\r ") else "")
    report = line_dedup.report(df, gone).collect()
    assert len(report) == len(xs) + 1
    assert all(r.n_removed == len(r.removed) == len(want.get(r.doc_id, [])) for r in report)
    assert line_dedup.decisions(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        kind = i % 5
        lines = [" ".join(rng.choice(POOL) for _ in range(rng.randint(8, 20))) for _ in range(rng.randint(3, 8))]
        if kind == 0:
            lines = [" ".join(w.upper() + "###" for w in x.split()) for x in lines]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 1))
        labels.append((i, int(kind > 0), 0))
    rows += [(1000 + i, rows[1 + 5 * i][1], "en", "s0", 1) for i in range(5)]  # copies
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (None, rows[1][1], "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outs[name] = docs.collect()
        assert name == "bpe_codec" or docs.columns == columns
    kept = {r.doc_id for r in outs["quality_rules"]}
    assert {i for i in range(240) if i % 5} <= kept and not {2000, 2001, None} & kept and len([i for i in kept if i % 5 == 0 and i < 240]) <= 3
    lines = [x for r in outs["line_dedup"] for x in r.text.split("\n")]
    assert len(lines) == len(set(lines)) and {i for i in range(240) if i % 5} <= {r.doc_id for r in outs["line_dedup"]}
    assert not any(r.doc_id >= 1000 for r in outs["line_dedup"])  # nothing is left of a copy
    assert {r.doc_id for r in outs["ngram_jaccard_join"]} == {r.doc_id for r in outs["line_dedup"]}
    size = collections.Counter()
    for r in outs["mixing"]:
        size[r.source] += len(r.text.split())
    total = sum(len(r.text.split()) for r in outs["ngram_jaccard_join"])
    assert abs(sum(size.values()) - 1.5 * total) <= 3
    assert len(outs["bpe_codec"]) == len(outs["mixing"]) and all(len(r.ids) == r.n_tokens > 0 for r in outs["bpe_codec"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(outs["bpe_codec"])


def test_pipeline_stages_with_repeated_rows(spark, tmp_path):
    rng = random.Random(10)
    text = lambda n: " ".join(rng.choice(POOL) + str(rng.randint(0, 99)) for _ in range(n))
    rows = [(i, text(40), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [rows[i] for i in range(12) for _ in range(3)]  # repeated rows
    other = text(40)
    rows += [(59, other, "en", "s2", 1), (58, "too short", "en", "s1", 1)]  # other texts under a known id
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(5)
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {(i, t) for i, t, *_ in rows if t != "too short"}
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()
    assert len(kept) == len(rows) - 1 and {(r.doc_id, r.text) for r in kept} == want
    near = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(kept, schema), str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in near.collect()) == sorted(want)
    for given in (kept, near.collect()):
        out = corpus_pipeline.mixture(spark, spark.createDataFrame(given, schema), str(tmp_path)).collect()
        size = collections.Counter()
        for r in out:
            size[r.source] += len(r.text.split())
        assert abs(sum(size.values()) - 1.5 * 40 * len(want)) <= 3
        assert {r.doc_id for r in out} <= set(range(60)) and len(out[0]) == 5


def test_first_line_stays_whatever_the_order_of_rows(spark):
    line = "the quick brown fox jumps over the lazy dog while nine old owls watch from the barn roof in silence " * 2
    near = line[:100] + "X" + line[101:]
    rows = [(3, line), (2, near), (1, line), (0, "nothing in common with the others at all")]
    for given in (rows, rows[::-1], rows[1:] + rows[:1]):
        gone = line_dedup.decisions(spark.createDataFrame(given, "doc_id long, text string").coalesce(1)).collect()
        assert {r.id: list(r.removed) for r in gone} == {2: [0], 3: [0]}


def test_lines_of_repeated_ids_and_rows(spark):
    same = "a line that several of the rows hold, long enough to be compared"
    rows = [
        ("b", same), ("e", same + "\nits own words are nowhere else to be found in here"), ("e", "a wholly unique sentence of this row\nand another one of its own kind"),
        ("g", "these two rows are one and the same\nwith a second line"), ("g", "these two rows are one and the same\nwith a second line"), ("g", "these two rows are one and the same\nwith a second line"),
        ("h", " \n "), ("h", " \n "),
    ]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id string, text string, copies int").repartition(4)
    gone = line_dedup.decisions(df)
    report = sorted((r["doc_id"], r["n_lines"], list(r["removed"])) for r in line_dedup.report(df, gone).collect())
    assert report == sorted([("b", 1, []), ("e", 2, [0]), ("e", 2, []), ("g", 2, []), ("g", 2, [0, 1]), ("g", 2, [0, 1]), ("h", 0, []), ("h", 0, [])])
    out = line_dedup.apply(df, gone)
    assert out.columns == df.columns
    left = sorted((r["doc_id"], r["text"]) for r in out.collect())
    assert left == sorted([("b", same), ("e", "its own words are nowhere else to be found in here"), rows[2], rows[3], rows[6], rows[7]])


def test_bands_find_similar_lines(spark):
    """Recall of the shipped bands on planted pairs of similarity 0.8 to 0.9."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    rows, pairs = [], 0
    for i in range(500):
        line = "".join(rng.choice(letters) for _ in range(160))
        at = rng.sample(range(10, 150, 12), rng.choice((1, 2)))
        near = "".join("#" if k in at else c for k, c in enumerate(line))
        a, b = ({x[k : k + 7] for k in range(len(x) - 6)} for x in (line, near))
        pairs += 0.8 <= len(a & b) / len(a | b)
        rows += [(2 * i, line), (2 * i + 1, near)]
    gone = line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string"))
    found = gone.count()
    print(f"recall of lines {found / pairs:.4f}")
    assert pairs > 400 and 0.95 * pairs <= found <= pairs


def test_join_of_repeated_ids_and_rows(spark):
    rng = random.Random(6)
    one, other = (" ".join(rng.choice(POOL) for _ in range(80)) for _ in range(2))
    near = one.replace(one.split()[40], "changed", 1)
    rows = [("c", one), ("c", other), ("d", near), ("d", near), ("c", one), ("a", "x y z")]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted([("c", "c", 1), ("c", "c", 1), ("d", "c", 1), ("d", "c", 1), ("c", "c", 0), ("a", "a", 0)])


def test_line_stage_of_repeated_rows(spark, tmp_path):
    rng = random.Random(11)
    text = lambda: "\n".join(" ".join(rng.choice(POOL) + str(rng.randint(0, 999)) for _ in range(12)) for _ in range(3))
    rows = [(i % 20, text(), "en", "s", 1) for i in range(40)]
    rows += rows[:6] + rows[:6]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted({r[:2] for r in rows})
