"""License scans, periodic runs and token alignment against plain Python on small and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyscope.llm import alignment, license_scan, periodic_runs
from tallyscope.llm.queries import BYTES_50K, PIECES_32K, QUERIES, planted

FOLDER = "/root/testdata/sf0.001"
ODD = [
    None, "", " \t\n", "a", "a▁b", "<|endoftext|> x <s>", "  two  spaces\n\n\t end ", "日本語テキスト 😀 é", "x" * 3000, "naïve ﬁ   z　z", "\r\n \x0b\x0c.",
    "Released under the MIT License.", "Under the MIT. under-the\nMIT LICENSE cc by-nc 4", "cc by nc cc by nc", "undér the mit license", "under the mit licenses",
    "ab " * 40, "ab " * 40,
]


def frame(spark, texts):
    """Rows of odd ids with extra columns that clash with the operators' own."""
    rows = [(None if k == 1 else k // 2, x, "en", k) for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, chunk int").repartition(3)


def texts_of(spark, folder=FOLDER):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


# ---- license scan

def brute_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_licenses(text, templates=license_scan.TEMPLATES, threshold=0.8):
    words = brute_words(text)
    at = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    blocks = set()
    for label, notices in templates.items():
        for notice in notices:
            wanted, m = brute_words(notice), 1
            while m < len(wanted):
                m *= 2
            for start in range(0, max(1, len(words)), m):
                share = len({*wanted} & {*words[start : start + 2 * m]}) / len({*wanted})
                if share >= threshold - 1e-9:
                    blocks.add((label, start, min(start + 2 * m, len(words)), round(share, 9)))
    return len(words), sorted(at), sorted(blocks)


def licensed(rng):
    notices = [x for group in license_scan.TEMPLATES.values() for x in group]
    made = []
    for _ in range(120):
        filler = [rng.choice(("the", "of", "license", "software", "copy", "and", "lorem", "under", "to", "rights", "version")) for _ in range(rng.randint(0, 90))]
        words = rng.choice(notices).split()
        words = [x for x in words if rng.random() > rng.choice((0, 0.1, 0.25))]
        at = rng.randint(0, len(filler))
        made.append(rng.choice((" ", "\n", ", ")).join(filler[:at] + words + filler[at:]))
    return made


def test_license_scan_against_brute_force(spark):
    texts = ODD + licensed(random.Random(7)) + [" ".join(["lorem"] * 30_000) + " All Rights\nReserved"]
    got = license_scan.scan(frame(spark, texts)).withColumn("k", F.lit(0)).collect()
    want = sorted((brute_licenses(x) for x in texts), key=repr)
    found = sorted(((r["n_words"], sorted((p["start"], p["label"]) for p in r["places"]), sorted({(b["label"], b["start"], b["end"], round(b["containment"], 9)) for b in r["blocks"]})) for r in got), key=repr)
    assert found == want
    assert sum(bool(x[2]) for x in want) > 50


def test_license_digest_and_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op11_license_scan"](spark, FOLDER).collect()}
    texts = dict(texts_of(spark))
    assert rows.keys() == texts.keys()
    for doc, text in texts.items():
        n, at, blocks = brute_licenses(text)
        r = rows[doc]
        assert (r["n_words"], r["n_base"]) == (n, len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert r["labels"] == ",".join(sorted({x for _, x in at} | {b[0] for b in blocks}))
        assert r["score"] == pytest.approx(1.0 if at else max([b[3] for b in blocks], default=0.0))


def test_license_templates_are_parameters(spark):
    docs = frame(spark, ["one two three four", "one two", ""])
    got = license_scan.digest(license_scan.scan(docs, phrases={}, templates={"x": ("one two three four",)}, threshold=0.5))
    assert sorted((r["labels"], r["score"]) for r in got.collect()) == [("", 0.0), ("x", 0.5), ("x", 1.0)]
    assert license_scan.scan(docs, templates={}).count() == 3
    assert license_scan.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs, most=10)


# ---- periodic runs

def brute_runs(w, least=24, times=3):
    out = []
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least, times * p) and not any(w[i : i + length - q] == w[i + q : i + length] for q in range(1, p)):
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, times", [(2, 2), (5, 2), (9, 3), (24, 3)])
def test_runs_of_small_alphabets(least, times):
    rng = random.Random(least)
    for _ in range(250):
        n = rng.randint(0, 70)
        w = [rng.randint(0, rng.choice((0, 1, 2, 4))) for _ in range(n)]
        if n > 6 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 12)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        got = periodic_runs.runs_of([w, w[: n // 2], []], least, times)
        assert [[tuple(r) for r in x.tolist()] for x in got] == [brute_runs(x, least, times) for x in (w, w[: n // 2], [])]


def brute_digest(words):
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    hashed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashed(lines), hashed(" ".join(x for i, x in enumerate(words) if i not in drop)))


def brute_planted(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_runs_query_against_brute_force(spark):
    rows = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    # brute force is quadratic in the number of words: longer texts are held by the other tests
    short = {d: w for d, t in texts_of(spark) if len(w := brute_planted(d, t)) < 500}
    assert len(rows) == len(texts_of(spark)) and len(short) > 150
    for doc, words in short.items():
        assert rows[doc] == brute_digest(words), doc
    assert sum(r[0] > 0 for r in rows.values()) > 5


def test_runs_of_odd_rows(spark):
    long = [str(i % 3500) for i in range(12_000)]
    texts = ODD + [" ".join(long), "x " + "ab cd " * 12 + "y " + "k " * 24, "z " * 23, "a b c d e f g h " * 3, "a b c d e f g h i " * 3, "one\x00two " * 30]
    got = periodic_runs.digest(periodic_runs.find(frame(spark, texts))).collect()
    want = [brute_digest(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for x in texts if x is None or len(x) < 9000]
    long_run = (1, 0, 12_000, 3500, 3428)
    found = [tuple(r)[1:] for r in got]
    assert sorted(map(repr, want)) == sorted(repr(x) for x in found if x[:5] != long_run)
    assert sum(x[:5] == long_run for x in found) == 1
    assert periodic_runs.find(frame(spark, texts).limit(0)).count() == 0


def test_planted_rows(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 37))) for k in range(300)] + [(None, "a b"), (20, None)]
    got = planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or -1), re.findall(r"\S+", r["text"] or "")) for r in got) == sorted(((d or -1), brute_planted(d, t)) for d, t in rows)


# ---- alignment

A, B = Tokenizer.from_file(BYTES_50K), sentencepiece.SentencePieceProcessor(model_file=PIECES_32K)
A.encode_special_tokens = True
LETTERS = {c: b for b, c in enumerate(alignment.ByteLevel(BYTES_50K).merges.letters)}


def brute_links(text):
    """Ids of both sides, groups and links of a text, or nothing."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    piece = [B.id_to_piece(i) for i in b]
    raw_a = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in piece]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], [], [], []
    owner_a, owner_b = ([i for i, x in enumerate(raw) for _ in x] for raw in (raw_a, raw_b))
    met = sorted({*zip(owner_a, owner_b)})
    groups, last = [([a[0]], [b[0]])], (0, 0)
    for (i, j), (i0, j0) in zip(met[1:], met):
        if i > i0 and j > j0:
            groups.append(([a[i]], [b[j]]))
        elif i > i0:
            groups[-1][0].append(a[i])
        else:
            groups[-1][1].append(b[j])
    return a, b, groups, [(a[i], b[j]) for i, j in met]


def brute_alignment(texts):
    each = [brute_links(t) for t in texts]
    counts = Counter(x for e in each for x in e[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    for a, b, groups, links in each:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield (len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if a else "")


def test_alignment_of_odd_rows(spark):
    texts = ODD + ["\n".join(t for _, t in texts_of(spark)[:40] if t)]
    got = alignment.digest(frame(spark, texts), alignment.ByteLevel(BYTES_50K), alignment.Pieces(PIECES_32K))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(brute_alignment(texts))


def test_alignment_query_against_the_libraries(spark):
    rows = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_tokenizer_alignment"](spark, FOLDER).collect()}
    pairs = texts_of(spark)
    assert rows == dict(zip([d for d, _ in pairs], brute_alignment([t for _, t in pairs])))


def test_alignment_does_not_depend_on_chunks(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    a, b = alignment.ByteLevel(BYTES_50K), alignment.Pieces(PIECES_32K)
    from tallyscope.session import durable

    one, many = (alignment.count_links(durable(alignment.align(docs, a, b, chunk=size))).orderBy("doc_id").collect() for size in (1 << 22, 1 << 12))
    assert one == many and alignment.align(docs.limit(0), a, b).count() == 0


def test_encoders_on_long_runs():
    a = alignment.ByteLevel(BYTES_50K)
    for text in (" " * 30_000 + "x", "\t\n" * 15_000, "y" * 50_000, "<|endoftext|>" * 3, "a " * 100):
        assert a.encode([text])[0] == A.encode(text, add_special_tokens=False).ids
    a.ranks = None
    assert a.encode(["it's  1234 odd\n\n "])[0] == A.encode("it's  1234 odd\n\n ", add_special_tokens=False).ids


def test_public_files_are_found():
    assert public_tokenizers.path("piece_bpe_32k.model") == PIECES_32K
