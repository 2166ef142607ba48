"""Documents of similar word n-grams, candidates pruned by Bayesian inference.

Equal texts are one item. Of each item the n-grams of words (runs between white
space; a shorter text is one n-gram) are hashed and MinHash values taken. Banding
proposes pairs. A pair's values are then compared ``step`` at a time, and it is
dropped as soon as the posterior probability that its Jaccard similarity reaches
``threshold`` falls below ``tolerance``. What is left is verified exactly on the
sets of n-grams.

With 24 bands a pair of similarity 0.8 is missed with probability 3e-6, and the
default tolerance of 1e-6 drops about as few.

Null texts count as empty. Texts without a word link to nothing, but equal ones are
one class. Rows without an id are left out. Rows that share an id are judged by their
own texts; repeated rows are copies. Ids of any type that can be ordered will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .columns import flat, mix, packed, pieces, run_hashes, spans_of
from .pairing import if_small, least_matches, minhash, similar

_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def ngrams(offsets: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows in order, and where each row's begin (one more than rows)."""
    start, end, row = spans_of(offsets, data, _BLANK)
    words = run_hashes(data, start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    grams = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    begin = np.append(0, np.cumsum(grams))
    head = np.cumsum(count) - count
    place = np.repeat(head - begin[:-1], grams) + np.arange(begin[-1])
    last = np.repeat(head + count, grams)
    out = np.zeros(len(place), np.uint64)
    for k in range(n):
        inside = place + k < last
        word = np.where(inside, words[np.minimum(place + k, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else out
        out = out * np.uint64(0x9E3779B97F4A7C15) + word + inside.astype(np.uint64)
    return mix(out), begin


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, bands: int = 24, size: int = 128, step: int = 32, tolerance: float = 1e-6) -> DataFrame:
    """``id_col``, ``class_id`` (smallest id connected by equality or links) and ``n_links`` (other texts it links to)."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("id IS NOT NULL")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            grams, begin = ngrams(*flat(part.column(1)), n)
            some = np.diff(begin) > 0
            signs = np.zeros((part.num_rows, size), np.uint16)
            signs[some] = minhash(grams, begin[:-1][some], size)
            bits = packed(signs).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x if s else None for x, s in zip(bits, some)], pa.binary())], ["id", "equal", "sign"])

    docs = docs.select("id", "text", F.unhex(F.md5("text")).alias("equal"))
    kind = docs.schema["id"].dataType.simpleString()
    signed = durable(docs.mapInArrow(sign, f"id {kind}, equal binary, sign binary"))
    classes = signed.groupBy("equal").agg(F.min("id").alias("rep"), F.first("sign").alias("sign"))
    # numbers are fixed by the written table
    classes = durable(classes.select(F.monotonically_increasing_id().alias("item"), "equal", "rep", "sign"))
    items = classes.filter("sign IS NOT NULL").select(F.col("item").alias("id"), "sign")

    def fetch(wanted: DataFrame, rows: int) -> DataFrame:
        at = classes.select("item", "equal", F.col("rep").alias("id")).join(if_small(wanted.withColumnRenamed("id", "item"), rows), "item", "left_semi")
        at = if_small(durable(at), rows)
        return docs.join(at, ["id", "equal"]).select(F.col("item").alias("id"), "text").dropDuplicates(["id"])  # a row may repeat

    def sets(texts: list[str]) -> list[np.ndarray]:
        grams, begin = ngrams(*flat(pa.array(texts, pa.large_string())), n)
        return [grams[a:b] for a, b in zip(begin[:-1], begin[1:])]

    links, linked = similar(items, fetch, sets, bands, threshold, least_matches(size, step, threshold, tolerance))
    about = classes.select("item", "equal", "rep").join(linked.withColumnRenamed("id", "item"), "item", "left").join(links.withColumnRenamed("id", "item"), "item", "left")
    about = durable(about.select("equal", "rep", "component", F.coalesce("links", F.lit(0).cast("long")).alias("n_links")))
    # a component is named by its smallest id
    names = durable(about.filter("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("class_id")))
    about = about.join(names, "component", "left").select("equal", F.coalesce("class_id", "rep").alias("class_id"), "n_links")
    return signed.select("id", "equal").join(about, "equal").select(F.col("id").alias(id_col), "class_id", "n_links")
