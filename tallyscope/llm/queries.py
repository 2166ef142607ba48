"""The operators bound to the benchmark tables, each over its whole table.

``QUERIES`` maps names to (spark, folder of the tables) -> result, ``ORACLE`` has
the SQL of those that SQL can express; the others are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from . import alignment, bpe_codec, jaccard_join, license_scan, line_dedup, mixing, neighbours, periodic_runs, perplexity, quality_rules, secret_scan, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Paths of the public vocabularies.
WORDS_49K = public_tokenizers.path("word_bpe_49k.json")
BYTES_50K = public_tokenizers.path("byte_bpe_50k.json")
PIECES_32K = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None) -> Callable:
    def wrap(run: Callable) -> Callable:
        def bound(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            return run(spark, lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        QUERIES[name] = bound
        if sql:
            ORACLE[name] = sql
        return run

    return wrap


@query("op1_secret_scan")
def _secrets(spark, table):
    return secret_scan.digest(secret_scan.scan(table("documents")))


@query("op2_line_dedup")
def _lines(spark, table):
    docs = table("documents")
    return line_dedup.report(docs, line_dedup.decisions(docs))


@query("op3_toxicity")
def _toxicity(spark, table):
    docs, held_out = table("documents"), toxicity.fold() == 1
    model = toxicity.train(docs, table("labels").filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")


@query("op4_ngram_jaccard_join")
def _similar(spark, table):
    return jaccard_join.join(table("documents"))


@query("op5_quality_rules")
def _quality(spark, table):
    judged = quality_rules.quality(table("documents"), table("labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS key
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM docs GROUP BY source),
line AS (
  SELECT *, 2.0 * source_size AS lim, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS total, sum(weight) OVER () AS everyone,
         sum(2.0 * source_size) OVER w AS used, sum(weight) OVER w AS carried
  FROM sizes WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
filled AS (
  SELECT *, (total - used + lim) / (everyone - carried + weight) * weight >= lim AS is_full FROM line),
level AS (
  SELECT coalesce(
    (SELECT (total - used) / (everyone - carried) FROM filled WHERE is_full AND everyone > carried ORDER BY everyone - carried LIMIT 1),
    (SELECT max(total / everyone) FROM filled)) AS height),
goals AS (
  SELECT source, source_size, CAST(CASE WHEN is_full THEN lim ELSE height * weight END AS DOUBLE) AS target FROM filled, level),
placed AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
rounds AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS full_rounds FROM placed)
SELECT doc_id, source, size, source_size, target, start,
       CAST(full_rounds * size + least(greatest(budget - full_rounds * source_size - start, 0), size) AS BIGINT) AS taken
FROM rounds
"""


@query("op6_mix_sources", MIX_SQL)
def _mixture(spark, table):
    return mixing.mix(table("documents"))


@query("op7_nearest_neighbours")
def _neighbours(spark, table):
    return neighbours.search(table("embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_bpe_codec")
def _codec(spark, table):
    coded = bpe_codec.encode(table("documents"), WORDS_49K)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op9_token_counts")
def _tokens(spark, table):
    return token_counts.count_tokens(table("documents"), BYTES_50K)


@query("op10_quality_classifier")
def _perplexity(spark, table):
    return perplexity.classify(table("documents"), table("labels"))


@query("op11_license_scan")
def _licenses(spark, table):
    return license_scan.digest(license_scan.scan(table("documents")))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of ``docs``, where a tenth of the texts, told by a hash of the id, repeat words to their end.

    With h the CRC-32 of the decimal id, g = h div 10 and n words, a text of h % 10 = 0 and
    n > 0 repeats from word a = g % n on the p = 1 + (n - a) div (3 + g % 8) words there.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    text = F.expr("concat_ws(' ', slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return docs.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def _runs(spark, table):
    return periodic_runs.digest(periodic_runs.find(planted(table("documents"))))


@query("op13_tokenizer_alignment")
def _alignment(spark, table):
    return alignment.digest(table("documents"), alignment.ByteLevel(BYTES_50K), alignment.Pieces(PIECES_32K))
