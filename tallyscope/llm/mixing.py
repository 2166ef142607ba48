"""Mixing sources to target weights, exact to the word.

Every document gets a random key from a hash of its id. Within a source the
documents are put in the order of their keys; the leading digits of the key cut
this order into ranges, so that also a source with a third of all rows is sorted
by many tasks. Sums of sizes by range give each range its offset, a window inside
the range gives each document its own place in the source's line of words.
A source that may take T words then takes the first T places of this line,
beginning again as often as needed. The document at the cut is taken in part.

Targets: sources in order of their name's code points, null last, carry the
repeating ``weights`` and share ``share`` times all words by weight. No target is
above ``most`` times its source's words; what is left over is shared again by
weight among the others until none is above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What a word is made of: anything but the space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one row a source (``source``, ``source_size``).

    Sharing again until none is above its limit ends with one common level: a
    source gets the smaller of its limit and level times weight. Sources are
    ordered by limit over weight; those before the level's place are full.
    One row a source, so the ordered windows are small.
    """
    everything = W.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    line = sizes.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    line = line.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = everything.orderBy(F.col("limit") / F.col("weight"), "place")
    upto, behind = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(1, W.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    line = line.withColumns({
        "left": total - F.sum("limit").over(upto),
        "rest": F.coalesce(F.sum("weight").over(behind), F.lit(0.0)),
        "total": total, "all": F.sum("weight").over(everything),
    })
    # a source is full if the level among it and those behind reaches its limit
    full = (F.col("left") + F.col("limit")) / (F.col("rest") + F.col("weight")) * F.col("weight") >= F.col("limit")
    level = F.coalesce(
        F.min(F.when(full & (F.col("rest") > 0), F.struct(F.col("rest"), (F.col("left") / F.col("rest")).alias("level"))))
        .over(everything)["level"],
        F.col("total") / F.col("all"),
    )
    line = line.withColumn("full", full).withColumn("level", level)
    return line.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (3, 1, 2),
        share: float = 1.5, most: float = 2.0, seed: str = "mix", digits: int = 2, row_cols: Sequence[str] = ()) -> DataFrame:
    """One row a document: id, source, ``size``, ``source_size``, ``target``, ``taken`` and ``start``.

    ``start`` is the document's first place in its source's line of words.
    ``digits`` leading hexadecimal digits of the key are one range of the sort;
    they only set how finely a source is dealt out. Rows with the same id are
    told apart by size and ``row_cols`` (which the result has, too), so equal rows
    may swap places but nothing else.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"), *row_cols)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    docs = docs.withColumn("key", key).withColumn("cut", F.substring("key", 1, digits))
    ranges = docs.groupBy("source", "cut").agg(F.sum("size").alias("here"))
    sizes = ranges.groupBy("source").agg(F.sum("here").alias("source_size"))
    before = W.partitionBy("source").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here")
    plan = targets(sizes, weights, share, most)
    known = offsets.join(plan, offsets["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    inside = W.partitionBy("source", "cut").orderBy("key", "id", "size", *row_cols).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = docs.withColumn("upto", F.sum("size").over(inside))
    both = placed.join(known, placed["source"].eqNullSafe(known["source"]) & (placed["cut"] == known["cut"])).drop(known["source"], known["cut"])
    start = F.col("offset") + F.col("upto") - F.col("size")
    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.least(F.greatest(rest - start, F.lit(0)), F.col("size"))
    return both.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"), start.alias("start"), *row_cols,
    )


def apply(df: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_cols: Sequence[str] = ()) -> DataFrame:
    """The mixed corpus: whole documents as often as ``plan`` takes them, and the first words at a cut.

    Id and ``row_cols`` together are unique here. Columns are those of ``df``.
    """
    own = plan.select(F.col(id_col).alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken"), *[F.col(c).alias(f"_own_{c}") for c in row_cols])
    whole = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size"))).otherwise(0).cast("int")
    part = F.when(F.col("_size") > 0, F.col("_taken") % F.col("_size")).otherwise(0).cast("int")
    same = df[id_col].eqNullSafe(own["_id"])
    for c in row_cols:
        same = same & df[c].eqNullSafe(own[f"_own_{c}"])
    joined = df.join(own, same).withColumn("_whole", whole).withColumn("_part", part)
    repeats = F.concat(F.array_repeat(F.lit(0), F.col("_whole")), F.when(F.col("_part") > 0, F.array(F.col("_part"))).otherwise(F.array().cast("array<int>")))
    dealt = joined.withColumn("_words", F.explode(repeats))
    # pieces end with a word each, so the first n of them hold n words
    ended = F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col("_words") > 0, F.array_join(F.slice(ended, 1, F.greatest("_words", F.lit(1))), "")).otherwise(F.col(text_col))
    return dealt.withColumn(text_col, cut).select(*df.columns)
