"""The trigram model against the textbook formula, and a rare language."""

import collections
import math
import random

from tallyscope.llm import ngrams, perplexity


def brute_trigrams(train):
    """Log probability of a text by interpolated modified Kneser-Ney over all words."""
    seq = lambda t: ["<s>", "<s>", *t.split()]
    threes = collections.Counter(g for t in train for g in zip(seq(t), seq(t)[1:], seq(t)[2:]))
    twos = collections.Counter(g[1:] for g in threes)
    ones = collections.Counter(g[1:] for g in twos)

    def cut(counts):
        n = collections.Counter(counts.values())
        n1, n2, n3, n4 = (max(n[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return [0.0] + [min(max(x, 0.05), k) for x, k in zip(raw, (1, 2, 3))]

    tables = [(ones, cut(ones)), (twos, cut(twos)), (threes, cut(threes))]

    def p(gram):
        if not gram:
            return 1 / (len(ones) + 1)
        counts, d = tables[len(gram) - 1]
        own = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        n = counts[gram]
        return max(n - d[min(n, 3)], 0) / sum(own) + sum(d[min(x, 3)] for x in own) / sum(own) * p(gram[1:])

    return lambda t: sum(math.log(p(g)) for g in zip(seq(t), seq(t)[1:], seq(t)[2:]))


def test_trigrams_match_the_formula(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(12)]
    train = [" ".join(rng.choice(pool) if rng.random() < 0.9 else f"x{rng.random()}" for _ in range(rng.randint(1, 30))) for _ in range(80)]
    tests = [*train[:5], "", "w1 w2 new\tw3", None, "w1", "zz zz", " ".join(pool)]
    model, table = ngrams.train(spark.createDataFrame([(t,) for t in [*train, None, " "]], "text string"))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(tests)], "id long, text string, lang string")
    brute = brute_trigrams(train)
    for chunk in (64, 1 << 20):
        got = {r.id: r for r in ngrams.score(docs, model, table, chunk=chunk).collect()}
        for i, t in enumerate(tests):
            assert got[i].words == len((t or "").split())
            assert math.isclose(got[i].log_probability, brute(t or ""), rel_tol=1e-9, abs_tol=1e-9)
    assert model.types == len({w for t in train for w in t.split()})
    empty, none = ngrams.train(spark.createDataFrame([], "text string"))
    assert [r.log_probability for r in ngrams.score(docs, empty, none).collect()] == [0.0] * len(tests)


def test_words_of_a_rare_language_are_told_apart(spark):
    rng = random.Random(7)
    pool = {"en": [f"e{i}" for i in range(50)], "xx": [f"x{i}" for i in range(400)]}
    rows = [(i, " ".join(rng.choice(pool["en"]) for _ in range(2000)), "en") for i in range(600)]
    rows += [(1000 + i, " ".join(rng.choice(pool["xx"]) for _ in range(20)), "xx") for i in range(100)]
    labels = [(r[0], 1) for r in rows]
    # below 5e-5 of all words each, so all of them were the unknown word before
    assert 100 * 20 / 400 / (600 * 2000) < 5e-5
    rows += [(2000 + i, " ".join(f"junk{rng.random()}" for _ in range(20)), "xx") for i in range(50)]
    got = {r.doc_id: r for r in perplexity.classify(
        spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert sum(got[1000 + i].kept for i in range(100)) >= 90
    assert not any(got[2000 + i].kept for i in range(50))
