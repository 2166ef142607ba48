"""A corpus pipeline: quality rules, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, folder of the tables), works on all documents that the
stage before it kept, and returns documents of the same columns; the last returns
token ids. Documents without an id go with the first stage.

An id may repeat. Rows are told apart by id and text (its hash), and judged one by
one; of rows equal in both one is left by line dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import bpe_codec, jaccard_join, line_dedup, mixing, quality_rules
from tallyscope.llm.pairing import if_small
from tallyscope.llm.queries import WORDS_49K
from tallyscope.session import durable, tune


KEY = ["doc_id", "_row"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a hash of id and text."""
    return docs.withColumn("_row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose ``KEY`` is in ``rows``."""
    rows = durable(rows.select(*KEY).distinct())
    return docs.join(if_small(rows, rows.count()), KEY, "left_semi").select(*docs.columns)


def _once(docs: DataFrame) -> DataFrame:
    """One document of each ``KEY``, the smallest by its columns."""
    again = durable(docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*KEY))
    n = again.count()
    if not n:
        return docs
    again = if_small(again, n)
    first = docs.join(again, KEY, "left_semi").groupBy(*KEY).agg(F.min(F.struct(*[c for c in docs.columns if c not in KEY])).alias("x"))
    return docs.join(again, KEY, "left_anti").unionByName(first.select(*KEY, "x.*"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned one go."""
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    keyed = _keyed(docs)
    return _only(keyed, quality_rules.quality(keyed, labels, beside=["_row"]).filter("kept")).drop("_row")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines stays; documents left without content go."""
    tune(spark)
    return line_dedup.apply(docs, line_dedup.decisions(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or similar texts stays: the one of smallest id."""
    tune(spark)
    keyed = _keyed(docs).filter("doc_id IS NOT NULL")
    classes = jaccard_join.join(keyed, "_row").distinct()
    first = keyed.select(*KEY).distinct().join(classes, "_row").groupBy("class_id").agg(F.min(F.struct(*KEY)).alias("x"))
    return _once(_only(keyed, first.select("x.*"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may occur twice, one a source may be cut."""
    tune(spark)
    keyed = _once(_keyed(docs))
    return mixing.apply(keyed, durable(mixing.mix(keyed, row_cols=["_row"])), row_cols=["_row"]).drop("_row")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every document."""
    coded = bpe_codec.encode(docs, WORDS_49K)
    ids = F.when(F.col("n_tokens") > 0, F.split("ids", " ").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return coded.select("doc_id", "n_tokens", ids.alias("ids"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("mixing", mixture), ("bpe_codec", tokens)]

#: The learned rules, MinHash and BPE have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each read from what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
