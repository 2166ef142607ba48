"""Quality by perplexity under an interpolated modified Kneser-Ney model.

``classify`` takes trigrams over all words of the trusted documents (``ngrams``): the
tables grow with the input, and only words never seen share one price. All languages
are counted together; a word keeps its counts however small its language is.

A document is kept if its perplexity is at most the ``quantile`` of its language
among trusted documents that were left out of training (a tenth, by hash of the id);
a language without any takes the quantile of all. Without trusted documents there is
no threshold and every document with a word is kept. Null, empty and blank texts have
no perplexity and are not kept. Repeated ids stay separate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import ngrams
from .pairing import if_small


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality",
             trusted: Column | None = None, quantile: float = 0.995) -> DataFrame:
    """``id_col``, ``lang``, ``perplexity``, ``threshold`` and ``kept`` of every row; trusted are ids with label 1 (or ``trusted``)."""
    good = labels.filter(F.col(label_col) == 1 if trusted is None else trusted).select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    good = durable(good)
    near = if_small(good, good.count())
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    apart = F.pmod(F.xxhash64("id", F.lit("apart")), F.lit(10)) == 0
    model, table = ngrams.train(docs.filter(~apart).join(near, "id", "left_semi"))
    scored = ngrams.score(docs, model, table)
    perplexity = F.when(F.col("words") > 0, F.exp(-F.col("log_probability") / F.col("words")))
    scored = durable(scored.withColumn("perplexity", perplexity))
    left_out = scored.filter(apart & F.col("perplexity").isNotNull()).join(near, "id", "left_semi")
    borders = left_out.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("border"))
    anywhere = left_out.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("border")).first()[0]
    own = borders.withColumnRenamed("lang", "_lang")
    judged = scored.join(own, scored["lang"].eqNullSafe(own["_lang"]), "left").withColumn("threshold", F.coalesce("border", F.lit(anywhere).cast("double")))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return judged.select(F.col("id").alias(id_col), "lang", "perplexity", "threshold", kept.alias("kept"))
