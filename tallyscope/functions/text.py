"""Name tokens, keyword routing, long-text chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not count when vendor names are compared.
NAME_STOPWORDS = ("and", "the", "of", "pvt", "ltd", "co")


def name_tokens(name: Column) -> Column:
    """Distinct lower-case words of a name without company suffixes."""
    words = F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in NAME_STOPWORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; NULL when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def names_similar(a: Column, b: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(jaccard(name_tokens(a), name_tokens(b)) > threshold, F.lit(False))


def chunk_paragraphs(text: Column, max_chars: int = 4000) -> Column:
    """Greedy packing of blank-line separated paragraphs into trimmed chunks.

    The separator counts towards the limit, also before the first paragraph. A
    longer paragraph stays whole in a chunk of its own; blank text is kept as is.
    """
    sep = F.lit("\n\n")
    strings = F.array().cast("array<string>")
    # finished chunks wait in a short list, which is put away when it is full: none is copied many times
    start = F.struct(F.array().cast("array<array<string>>").alias("away"), strings.alias("done"), F.lit("").alias("cur"))

    def strip(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def step(s: Column, p: Column) -> Column:
        over = F.length(s["cur"]) + F.length(p) + 2 > max_chars
        full = F.size(s["done"]) >= 256
        done = F.when(full, strings).otherwise(s["done"])
        return F.struct(
            F.when(full, F.concat(s["away"], F.array(s["done"]))).otherwise(s["away"]).alias("away"),
            F.when(over & (s["cur"] != ""), F.concat(done, F.array(strip(s["cur"])))).otherwise(done).alias("done"),
            F.when(over, p).otherwise(F.concat(s["cur"], sep, p)).alias("cur"),
        )

    def finish(s: Column) -> Column:
        last = F.when(strip(s["cur"]) == "", s["done"]).otherwise(F.concat(s["done"], F.array(strip(s["cur"]))))
        return F.flatten(F.concat(s["away"], F.array(last)))

    packed = F.aggregate(F.split(text, sep), start, step, finish)
    return F.when(F.size(packed) == 0, F.array(text)).otherwise(packed)


# Words that send a finding text to a report section.
TOPIC_WORDS = {"muster_roll": "muster|attendance", "network": "network|circular|hub account"}


def topics(text: Column, words: dict[str, str] = TOPIC_WORDS) -> Column:
    """Report sections a finding text belongs to."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), name) for name, p in words.items()]))
