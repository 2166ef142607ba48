"""Mixing, quality rules, toxicity, neighbours and perplexity against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyscope.llm import mixing, neighbours, perplexity, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_mix(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """(id, source, size) -> {id: taken}, targets by sharing again until none is above."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(z for _, t, z in rows if t == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    left, open_, target = share * sum(size.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] >= most * size[s]}
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in above:
            target[s] = most * size[s]
            left -= target[s]
        open_ -= above
    taken = {}
    for s in sources:
        line, at, budget = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, z) for i, t, z in rows if t == s), 0, math.floor(target[s])
        for _, i, z in line:
            rounds, rest = divmod(budget, size[s]) if size[s] else (0, 0)
            taken[i] = rounds * z + min(max(rest - at, 0), z)
            at += z
    return target, taken


def test_mix_matches_plain_python(spark):
    rng = random.Random(1)
    for trial in range(3):
        rows = [(i, rng.choice(["b", "a", "ä", None, "hot", "hot", "hot"]), " ".join("x" * rng.randint(0, 40)) if rng.random() > 0.1 else None) for i in range(300)]
        sized = [(i, s, len(WORD.findall(t or ""))) for i, s, t in rows]
        target, taken = brute_mix(sized)
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))).collect()
        assert len(got) == len(rows)
        for r in got:
            assert math.isclose(r.target, target[r.source], rel_tol=1e-12) and r.taken == taken[r.doc_id] <= 2 * r.size
        for s, t in target.items():
            assert sum(r.taken for r in got if r.source == s) == math.floor(t + 1e-9)


def test_mixed_corpus_has_the_words_of_the_plan(spark):
    rows = [(i, f"s{i % 3}", " ".join(f"w{j}" for j in range(i % 9)) + " ") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.mix(df).cache()
    out = collections.Counter()
    for r in mixing.apply(df, plan).collect():
        out[r.doc_id] += len(WORD.findall(r.text))
    assert out == +collections.Counter({r.doc_id: r.taken for r in plan.collect()})
    assert mixing.mix(df.limit(0)).count() == 0


def brute_statistics(x):
    x = x or ""
    words = WORD.findall(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    seen, spare = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            spare += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in x), spare, len(covered)


def test_statistics_match_plain_python(spark):
    rng = random.Random(5)
    parts = ["a ", "b ", "c\n", "\n", " ", "a b a b a b a b a b ", "é#\t", "\x0b", "😀 ", "|"]
    xs = [None, "", " ", "a b " * 3000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(xs)), "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("id", F.lit("x"))
    for r in quality_rules.statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(xs[r.doc_id])


def test_decision_list_finds_planted_rules(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(25, 80))]
        kind = i % 6
        rows.append((i, " ".join(w.upper() for w in words) if kind == 0 else " ".join(w + "###" for w in words) if kind == 1 else " ".join(words)))
        labels.append((i, int(kind > 1)))
    rows += [(1000, None), (1001, "too short"), (1002, "same " * 100)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5, None)], "doc_id long, quality int")
    judged = {r.doc_id: r for r in quality_rules.quality(docs, known).collect()}
    assert len(judged) == len(rows)
    assert all(judged[i].kept for i, q in labels if q)
    assert sum(not judged[i].kept for i, q in labels if not q) >= 0.95 * 300
    assert all(judged[i].base_failed and not judged[i].kept for i in (1000, 1001, 1002))
    stats = quality_rules.statistics(docs)
    assert quality_rules.learn(stats, known.limit(0)) == []
    assert quality_rules.quality(docs.limit(0), known).count() == 0
    assert quality_rules.judge(stats, []).filter("kept").count() == 900


def test_quality_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = quality_rules.judge(quality_rules.statistics(docs), [(quality_rules.Condition("symbols", True, 0.5),)])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def toxic_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice("abcdefgh") * rng.randint(2, 6) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 12))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            j = rng.randrange(len(sentences))
            sentences[j] += " " + rng.choice(["Vileword", "vilewords", "ÉVILX", "évilxy"])
        rows.append((i, ". ".join(sentences) + ".", toxic))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = toxic_rows(1, 1500)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, ""), (9002, "", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels.filter(toxicity.fold() != 1))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(got) == len(rows) + 2 and got[9001].score == got[9002].score == 0.0
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i].score >= 0.7) == bool(y) for i, _, y in held) >= 0.98 * len(held)
    for i, t, y in held:  # the offending sentence holds the planted word
        for s in got[i].offending:
            assert re.search("vile|évil", t[s.start : s.end].lower())
    # noisy-or of the sentences
    x = [r for r in got.values() if len(r.offending) > 1]
    assert all(r.score >= 1 - math.prod(1 - s.score for s in r.offending) - 1e-9 for r in x)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a. b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.train(df, none)).first().score < 0.01
    assert toxicity.score(df.limit(0), toxicity.train(df, none)).count() == 0


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 24))
    v[700:760] = v[0]  # equal vectors
    v *= rng.uniform(0.5, 2.0, (1500, 1))
    v[700:760] = v[0]
    rows = [(int(i), [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(2000, None, 0), (2020, [0.0] * 24, 0), (2040, [float("nan")] * 24, 0), (2060, [None] * 24, 0), (2080, [float("inf")] * 24, 0), (None, [1.0] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=10, block=400, query_block=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        scores = v @ v[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:10]
        hits += len({*best} & {i for i, _ in found})
        assert len(found) == 10 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, float(v[i] @ v[q]), rel_tol=1e-12, abs_tol=1e-12) for i, s in found)
    assert hits >= 0.95 * 10 * len(got)
    few = neighbours.search(df.filter("vec_id < 5"), F.col("vec_id") == 0, k=10)
    assert [r.rank for r in few.orderBy("rank").collect()] == [1, 2, 3, 4]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_recall_at_the_querys_parameters(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    ids, v = (np.array(x) for x in zip(*[(r.vec_id, r.embedding) for r in df.collect()]))
    got = collections.defaultdict(set)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = v @ v[q]
        scores[ids == ids[q]] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    recall = hits / (20 * len(got))
    print("recall", recall)
    assert len(got) == (ids % 20 == 0).sum() and recall >= 0.95


def test_windows_count_each_row_once_in_an_array():
    # with windows of all rows every row collides everywhere: the result is exact, whatever the steps were
    rng = np.random.default_rng(3)
    v, ids = rng.standard_normal((300, 8)), np.arange(300)
    for radius, growth in ((0.01, 1.3), (0.2, 2.0), (50.0, 1.1)):
        found = neighbours.search_block(v, ids, v[:20], ids[:20], float(np.sqrt((v**2).sum(axis=1)).max()), 299, 16, 0.1, growth, radius, 1)
        for q, rows, scores in found:
            assert sorted(rows.tolist()) == [i for i in range(300) if i != q]
            assert np.allclose(scores, v[rows] @ v[q]) and (np.diff(scores) <= 0).all()


def test_classifier_keeps_clean_and_drops_junk(spark):
    rng = random.Random(4)
    pool = {"en": [f"e{i}" for i in range(60)], "de": [f"d{i}" for i in range(60)]}
    rows, labels = [], []
    for i in range(800):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(pool[lang]) for _ in range(30)), lang))
        labels.append((i, 1))
    for i in range(800, 850):
        rows.append((i, " ".join(f"{rng.random()}" for _ in range(30)), "en"))
    rows += [(900, None, "en"), (901, "", None), (902, "e1 e2 e3 e4 e5 e6 e7 e8", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit(0))
    got = {r.doc_id: r for r in perplexity.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].kept for i in range(800)) >= 0.97 * 800
    assert not any(got[i].kept for i in range(800, 850)) and not got[900].kept and not got[901].kept and got[902].kept
    nothing = perplexity.classify(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert nothing.filter("kept").count() == 851
    assert perplexity.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0
