"""Toxicity by multiple-instance learning: documents are bags of sentences.

Only documents carry labels. A sentence's probability is logistic in its words'
features, a document is toxic unless all its sentences are clean (noisy-or):

    p(document) = 1 - product over sentences of (1 - p(sentence))

The likelihood of the documents' labels is maximised over the sentence weights, so
the model learns which sentences carry a label and can point at them afterwards.

Features are words and their first 3 to 7 bytes, hashed into ``1 << BITS`` places;
case is folded for ASCII and Latin-1 letters. Sentences end with one of ``.!?`` or
a line feed. Training takes at most ``sample`` labelled rows, those with the
smallest hashes of their ids; counting and scoring run in Spark over whole texts.
Null and empty texts have no sentence and score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import flat, mix, pieces, run_hashes, spans_of

BITS = 20
PREFIXES = range(3, 8)
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_STOP = np.isin(np.arange(256), list(b".!?\n"))
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _folded(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[accented] += 32
    return out


@dataclass
class Bags:
    """Words of a piece of the table. ``features``: a column each for the word and its prefixes, -1 for none."""

    rows: int
    sentence: np.ndarray  # of each word, from 0 on over the piece
    row: np.ndarray  # of each word
    features: np.ndarray
    home: np.ndarray  # row of each sentence
    begin: np.ndarray  # first and last byte of each sentence's words
    end: np.ndarray


def bags(offsets: np.ndarray, data: np.ndarray) -> Bags:
    data = _folded(data)
    start, end, row = spans_of(offsets, data, _GAP)
    mask = np.uint64((1 << BITS) - 1)
    columns = [run_hashes(data, start, end) & mask]
    length, h = end - start, np.zeros(len(start), np.uint64)
    for k in range(max(PREFIXES)):
        h = h * np.uint64(0x100000001B3) + data[np.minimum(start + k, max(len(data) - 1, 0))] + np.uint64(1)
        if k + 1 in PREFIXES:
            columns.append(np.where(length > k + 1, mix(h + (np.uint64(k + 1) << np.uint64(56))) & mask, np.uint64(1 << BITS)))
    features = np.column_stack(columns).astype(np.int64)
    features[features == 1 << BITS] = -1
    place = np.cumsum(_STOP[data])[start] + row if len(start) else np.zeros(0, np.int64)
    new = np.append(True, np.diff(place) != 0) if len(place) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return Bags(len(offsets) - 1, np.cumsum(new) - 1, row, features, row[first], start[first], end[last])


def _presence(b: Bags, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the piece with the number of positive and negative documents that hold them."""
    keys = (b.row[:, None] << BITS | b.features)[b.features >= 0]
    keys = np.unique(keys)
    found, at = np.unique(keys & (1 << BITS) - 1, return_inverse=True)
    positive = np.bincount(at, label[keys >> BITS], len(found)).astype(np.int64)
    return found, positive, np.bincount(at, minlength=len(found)) - positive


@dataclass(frozen=True)
class Model:
    """Weight by feature; most are zero."""

    weights: np.ndarray
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        """Log odds of each sentence."""
        by_word = np.append(self.weights, np.float32(0))[b.features].sum(axis=1)  # -1 takes the appended zero
        return np.bincount(b.sentence, by_word, len(b.home)) + self.bias

    def documents(self, b: Bags, odds: np.ndarray) -> np.ndarray:
        return -np.expm1(-np.bincount(b.home, np.logaddexp(0, odds), b.rows))


def fit_noisy_or(doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, plain: np.ndarray, label: np.ndarray, features: int, rounds: int = 400, decay: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all documents at once.

    An occurrence is (sentence, feature), ``doc`` is the document of each sentence;
    ``plain`` counts each document's sentences without a chosen feature.
    """
    w, bias = np.zeros(features), -4.0
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    n = max(len(label), 1)
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, w[feature], len(doc)) + bias
        dark = np.bincount(doc, np.logaddexp(0, z), len(label)) + plain * np.logaddexp(0, bias)
        # derivative of the log likelihood by the documents' exponent
        slope = np.where(label == 1, 1 / np.expm1(np.maximum(dark, 1e-9)), -1.0)
        by_sentence = slope[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, by_sentence[sentence], features) / n - decay * w,
                         (by_sentence.sum() + (slope * plain).sum() / (1 + np.exp(-bias))) / n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w + move[:-1], min(bias + move[-1], -1.0)
    return w, bias


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, gain: float = 25.0) -> Model:
    """Learn from the labelled documents; features enter by ``gain`` (twice the log likelihood ratio).

    Rows without a label are left out; of several labels of an id the highest counts.
    """
    spark = df.sparkSession
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # no more than ``sample`` rows of two numbers
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("label", "text")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            label = part.column(0).to_numpy(zero_copy_only=False)
            found, positive, negative = _presence(bags(*flat(part.column(1))), label)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(positive), pa.array(negative)], ["feature", "positive", "negative"])

    counts = docs.mapInArrow(presence, "feature long, positive long, negative long").groupBy("feature").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    n1, n0 = docs.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1)) - F.coalesce(F.sum("label"), F.lit(0))).first()
    weights = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        return Model(weights, -30.0 if not n1 else 30.0)

    def part(k: Column, n: Column | float, rate: Column) -> Column:
        return F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)

    a, b, n = F.col("positive"), F.col("negative"), n1 + n0
    rate = (a + b) / n
    score = 2 * (part(a, F.lit(n1), rate) + part(b, F.lit(n0), rate) + part(n1 - a, F.lit(n1), 1 - rate) + part(n0 - b, F.lit(n0), 1 - rate))
    chosen = np.sort(np.array([r[0] for r in counts.filter((a >= 5) & (a * n0 > b * n1) & (score >= gain)).select("feature").collect()], np.int64))  # at most 1 << BITS numbers
    if len(chosen) == 0:
        return Model(weights, float(np.log(n1 / n0)) - 4)
    picks = spark.sparkContext.broadcast(chosen)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.full((1 << BITS) + 1, -1, np.int32)
        own[picks.value] = np.arange(len(picks.value))
        for part_ in pieces(batches, 1):
            b_ = bags(*flat(part_.column(1)))
            hit = own[b_.features]
            word, _ = np.nonzero(hit >= 0)
            marked = np.unique(b_.sentence[word])
            plain = np.bincount(b_.home, minlength=b_.rows) - np.bincount(b_.home[marked], minlength=b_.rows)
            pairs = [np.stack([np.searchsorted(marked, b_.sentence[word]), hit[hit >= 0]])]
            homes = b_.home[marked]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes()]) for x in (part_.column(0).to_numpy(zero_copy_only=False), plain, homes, *pairs[0])], ["label", "plain", "home", "sentence", "feature"])

    got = [[np.frombuffer(x, "<i4") for x in r] for r in docs.mapInArrow(occurrences, "label binary, plain binary, home binary, sentence binary, feature binary").collect()]  # of the sample
    docs_before = np.cumsum([0, *[len(r[0]) for r in got]])
    sentences_before = np.cumsum([0, *[len(r[2]) for r in got]])
    w, bias = fit_noisy_or(
        np.concatenate([r[2] + d for r, d in zip(got, docs_before)]), np.concatenate([r[3] + s for r, s in zip(got, sentences_before)]),
        np.concatenate([r[4] for r in got]), np.concatenate([r[1] for r in got]), np.concatenate([r[0] for r in got]), len(chosen),
    )
    weights[chosen] = w
    return Model(weights, float(bias))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """``id_col``, ``score`` and ``offending``: sentences of probability ``offending`` or more, as code point spans."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for part in pieces(batches, 1):
            offsets, data = flat(part.column(1))
            b = bags(offsets, data)
            odds = m.sentences(b)
            chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            found: list[list[dict]] = [[] for _ in range(b.rows)]
            p = 1 / (1 + np.exp(-odds))
            for s in np.flatnonzero(p >= offending):
                home = int(b.home[s])
                base = chars[offsets[home]]
                found[home].append({"start": int(chars[b.begin[s]] - base), "end": int(chars[b.end[s]] - base), "score": float(p[s])})
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.documents(b, odds)), pa.array(found, kind)], ["id", "score", "offending"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, score double, offending array<struct<start:int,end:int,score:double>>"
    return narrow.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    """Remainder of the id's crc32; null is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))
