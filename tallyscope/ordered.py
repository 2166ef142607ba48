"""Ordered computations that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(..)`` sends every row of a key to one
task. When a key can hold a third of the table, that task never ends. The
functions here cut each key into *buckets* by a monotone expression of the
ordering column (a day, an hour, a log-scale value class), run the window inside
``(key, bucket)`` and add what comes from earlier buckets, which needs only one
summary row per bucket. A bucket that still holds too many rows (an hour of one key
with most of the table, or one instant) is cut into parts of about equal size at
borders drawn from its own rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def value_bucket(value: Column, per_octave: int = 64) -> Column:
    """Monotone integer class of a number: its exponent and the leading part of its mantissa.

    About 1 % wide at any magnitude, so shares and scores below 1 are told apart as
    well as amounts. Zero is class 0.
    """
    v = value.cast("double")
    size = F.abs(v)
    exponent = F.floor(F.log2(F.least(size, F.lit(1.7e308))))
    scaled = (exponent + 1100) * per_octave + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * per_octave)
    scaled = F.when(size == 0, F.lit(0)).otherwise(F.least(scaled, F.lit(2200 * per_octave))).cast("long")
    return F.when(v < 0, -scaled).otherwise(scaled)


def _null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right["_r_" + c])
    return cond


def attach(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``cols`` where NULL keys match, keeping the left columns once."""
    renamed = right.select(
        *[F.col(c).alias("_r_" + c) for c in cols],
        *[c for c in right.columns if c not in cols],
    )
    return left.join(renamed, _null_safe(left, renamed, cols), how).drop(*["_r_" + c for c in cols])


#: Rows of a (key, bucket) from which on it is cut into parts; sampled rows for a part.
MOST, _DRAWN, _SPAN = 500_000, 64, 32


def split(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = MOST) -> DataFrame:
    """``df`` with ``_part``, which cuts each (``keys``, ``_bucket``) of more than ``most`` rows along ``order``.

    Crowded buckets are found by counting. Their rows are drawn by a hash of the key and
    order, some ``_DRAWN`` for a part, and every ``_DRAWN``-th of the drawn ones, in
    order, is a border: parts hold ``most`` rows give or take a few eighths. A table
    without crowded buckets has no borders, and adaptive execution drops the join.
    """
    cut = [*keys, "_bucket"]
    crowded = df.groupBy(*cut).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > most)
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    drawn = attach(df.withColumn("_place", place), crowded, cut, "inner")
    share = F.lit(float(_DRAWN)) * (1 << 30) / most
    drawn = drawn.filter(F.pmod(F.xxhash64(*cut, "_place"), F.lit(1 << 30)) < share)
    found = drawn.groupBy(*cut).agg(F.array_sort(F.collect_list("_place")).alias("_all"))
    kept = F.filter("_all", lambda x, i: i % _DRAWN == _DRAWN - 1)
    borders = found.select(*cut, kept.alias("_borders")).withColumn("_heads", F.filter("_borders", lambda x, i: i % _SPAN == 0))
    joined = attach(df.withColumn("_place", place), borders, cut)
    # two steps: the span of borders, then the border inside it
    span = F.size(F.filter("_heads", lambda x: x <= F.col("_place")))
    inside = F.size(F.filter(F.slice("_borders", (span - 1) * _SPAN + 1, F.lit(_SPAN)), lambda x: x <= F.col("_place")))
    part = F.when(F.col("_borders").isNull() | (span == 0), 0).otherwise((span - 1) * _SPAN + inside)
    return joined.withColumn("_part", part).drop("_borders", "_heads", "_place")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    row_number: str | None = None,
    most: int = MOST,
) -> DataFrame:
    """Running sums, previous/next values and row numbers per key.

    ``order`` must be a total order inside a key and ``bucket`` must never
    decrease along it. ``sums`` are inclusive running sums. No window runs over many
    more than ``most`` rows.
    """
    sums, lags, leads = dict(sums or {}), dict(lags or {}), dict(leads or {})
    keys = list(keys)
    cut = [*keys, "_bucket", "_part"]
    base = split(df.withColumn("_bucket", bucket), keys, order, most)
    inside = W.partitionBy(*cut).orderBy(*order)
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    cols: dict[str, Column] = {"_rn": F.row_number().over(inside).cast("long")}
    for name, col in sums.items():
        cols[f"_s_{name}"] = F.sum(col).over(running)
    for name, col in lags.items():
        cols[f"_p_{name}"] = F.lag(col).over(inside)
    for name, col in leads.items():
        cols[f"_n_{name}"] = F.lead(col).over(inside)
        cols[f"_x_{name}"] = F.lead(F.lit(1)).over(inside)
    local = base.withColumns(cols)

    rank = F.struct(*order)
    totals = [F.count(F.lit(1)).alias("_cnt")]
    totals += [F.sum(col).alias(f"_t_{name}") for name, col in sums.items()]
    totals += [F.max_by(F.struct(col.alias("v")), rank).alias(f"_last_{name}") for name, col in lags.items()]
    totals += [F.min_by(F.struct(col.alias("v")), rank).alias(f"_first_{name}") for name, col in leads.items()]
    per_bucket = base.groupBy(*cut).agg(*totals)

    # one row per (key, bucket, part)
    steps = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket", "_part")
    before = steps.rowsBetween(W.unboundedPreceding, -1)
    off: list[Column] = [F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off")]
    off += [F.sum(f"_t_{name}").over(before).alias(f"_o_{name}") for name in sums]
    off += [F.lag(f"_last_{name}").over(steps).alias(f"_pl_{name}") for name in lags]
    off += [F.lead(f"_first_{name}").over(steps).alias(f"_nf_{name}") for name in leads]
    joined = attach(local, per_bucket.select(*cut, *off), cut, "inner")

    out: dict[str, Column] = {}
    if row_number:
        out[row_number] = F.col("_rn") + F.col("_off")
    for name in sums:
        s, o = F.col(f"_s_{name}"), F.col(f"_o_{name}")
        out[name] = F.when(s.isNull(), o).otherwise(s + F.coalesce(o, F.lit(0).cast("int")))
    for name in lags:
        out[name] = F.when(F.col("_rn") == 1, F.col(f"_pl_{name}")["v"]).otherwise(F.col(f"_p_{name}"))
    for name in leads:
        out[name] = F.when(F.col(f"_x_{name}").isNull(), F.col(f"_nf_{name}")["v"]).otherwise(F.col(f"_n_{name}"))
    return joined.withColumns(out).select(*df.columns, *out)


def _fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` rounded once, as SQL's quantile_cont computes it, by Dekker's product and Knuth's sum.

    The last bit of a percentile decides where values lie on the edge of a class.
    """
    def halves(x: Column) -> tuple[Column, Column]:
        head = x * 134217729.0 - (x * 134217729.0 - x)
        return head, x - head

    (ah, al), (bh, bl) = halves(a), halves(b)
    p = a * b
    s = p + c
    z = s - p
    lost = (((ah * bh - p) + ah * bl + al * bh) + al * bl) + ((p - (s - z)) + (c - z))
    return F.when(F.greatest(F.abs(a), F.abs(c)) < 1e290, s + lost).otherwise(s)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linear-interpolation percentiles per key, without buffering a group.

    Values are counted first, so equal values travel once; ranks then come from
    :func:`scan` over log-scale classes, and each percentile is read off the two
    rows around its rank.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = scan(counts, keys, [F.col("_v")], value_bucket(F.col("_v")), sums={"_cum": F.col("_n")})
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    # without keys there is one row of sizes
    both = attach(ranked, sizes, keys, "inner") if keys else ranked.crossJoin(F.broadcast(sizes))
    aggs: list[Column] = []
    read: list[Column] = []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        start = F.col("_cum") - F.col("_n")
        aggs += [
            F.max(F.when((start <= lo) & (lo < F.col("_cum")), F.col("_v"))).alias(f"_low{i}"),
            F.max(F.when((start <= hi) & (hi < F.col("_cum")), F.col("_v"))).alias(f"_high{i}"), F.max(pos - lo).alias(f"_frac{i}"),
        ]
        low, high, frac = (F.col(f"{c}{i}") for c in ("_low", "_high", "_frac"))
        read.append(F.when(frac == 0, low).otherwise(_fused(low, 1 - frac, high * frac)).alias(name))
    return both.groupBy(*keys).agg(*aggs).select(*keys, *read)
