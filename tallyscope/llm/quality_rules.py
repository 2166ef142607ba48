"""Quality rules as a decision list learned by sequential covering.

A rule is a conjunction of thresholds on a document's statistics and rejects what
it covers. Rules are learned one after the other from labelled rows: a rule grows
by the condition of most information gain on the growing rows, loses conditions at
its end while that does not hurt it on the pruning rows, and enters the list if it
is precise enough there; the rows it covers are set aside for the next one. The
list ends when no rule qualifies. It is applied as one ordered ``CASE WHEN``.

Everything runs as DataFrame expressions: texts are read once for the statistics,
learning counts labelled rows by (statistic, threshold) in Spark, and only these
counts, whose number depends on neither, reach the driver.

Null texts count as empty; empty tables and missing labels give an empty list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
_BLANKS = "".join(map(chr, (32, *range(9, 14))))
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "!?"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``use``."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` (a power of two) words that occur twice or more in the array.

    Windows are compared by 64-bit hashes built by doubling. Texts without a
    repeated window need no sort.
    """

    def doubled(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def windows(h: Column, step: int, then: Callable[[Column], Column]) -> Column:
        return then(h) if step == width else _let(doubled(h, step), lambda g: windows(g, 2 * step, then))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(w: Column) -> Column:
        marked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = _let(marked, lambda s: F.filter(
            F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])),
            lambda p: p.isNotNull(),
        ))
        return _let(F.sort_array(twice), covered)

    def counted(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(repeats(w))

    def of(words_: Column) -> Column:
        def whole(h: Column) -> Column:
            return _let(F.slice(h, F.lit(1), F.greatest(F.size(words_) - width + 1, F.lit(0))), counted)

        return _let(F.transform(words_, lambda w: F.xxhash64(w)), lambda h: windows(h, 1, whole))

    return _let(words, lambda w: F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(of(w)))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", beside: Sequence[str] = ()) -> DataFrame:
    """The statistics of every text beside its id and the columns ``beside``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), *beside)

    def without(chars: str) -> Column:
        return F.char_length("text") - F.char_length(F.translate("text", chars, ""))

    words = F.filter(F.split("text", SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    spare = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    both = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return docs.select(
        F.col("id").alias(id_col), both.alias("both"), (F.char_length("text") - without(_BLANKS)).cast("long").alias("word_chars"),
        without(_SYMBOLS).cast("long").alias("n_symbols"), spare.cast("long").alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines"),
        without(_UPPER).cast("long").alias("n_upper"), without(_MARKS).cast("long").alias("n_marks"), *beside,
    ).select(id_col, "both.n_words", "word_chars", "n_symbols", "n_dup_lines", "both.n_repeat_words", "n_lines", "n_upper", "n_marks", *beside)


def rates() -> dict[str, Column]:
    """What rules may test; all are defined for empty texts."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / words, "symbols": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeats": F.col("n_repeat_words") / words,
        "capitals": F.col("n_upper") / chars, "marks": F.col("n_marks") / words,
    }


@dataclass(frozen=True)
class Condition:
    rate: str
    above: bool  # >= threshold, else <
    threshold: float

    def column(self) -> Column:
        value = rates()[self.rate]
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule])


def rejected_by(rules: Sequence[Rule]) -> Column:
    """Number of the first rule that covers the row, from 0; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(covers(rule), F.lit(i)).otherwise(out)
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's information gain of narrowing (p0, n0) to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", grid: int = 64, precision: float = 0.98,
          least: int = 5, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """Rules for label 0 ("bad") from the labelled rows of ``stats``.

    About ``grid`` thresholds a statistic are quantiles, ends included, of its good and
    of its bad rows. A rule must reach ``precision`` on the pruning rows (a third, by
    hash of the id) and cover ``least`` bad ones there. Of several labels of an id the
    lowest counts.
    """
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    rows = durable(stats.join(known, id_col).select(
        (F.col("label") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64(F.col(id_col)), F.lit(3)) == 0).alias("pruning"),
        *[c for c in stats.columns if c != id_col],
    ))
    names = list(rates())
    probs = [2 * i / grid for i in range(grid // 2 + 1)]
    cuts = rows.agg(*[F.percentile_approx(F.when(F.col("bad") == side, c), probs, 10_000).alias(f"{k}{side}") for k, c in rates().items() for side in (0, 1)]).first()
    thresholds = {k: sorted({*(cuts[f"{k}0"] or []), *(cuts[f"{k}1"] or [])}) for k in names}
    # the number of thresholds that a value reaches
    places = [_place(c, thresholds[k]) for k, c in rates().items()]
    binned = durable(rows.withColumn("places", F.array(*places)))
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = binned.filter(rejected_by(rules).isNull())
        rule = _grow(left.filter(~F.col("pruning")), names, thresholds, most_conditions)
        rule = _prune(left.filter("pruning"), rule, precision, least) if rule else ()
        if not rule:
            break
        rules.append(rule)
    return rules


def _place(value: Column, thresholds: Sequence[float]) -> Column:
    if not thresholds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: value >= t))


def _grow(rows: DataFrame, names: Sequence[str], thresholds: dict[str, list[float]], most: int) -> Rule:
    rule: Rule = ()
    while len(rule) < most:
        held = rows.filter(covers(rule)) if rule else rows
        counted = held.select("bad", F.posexplode("places").alias("which", "place")).groupBy("which", "place").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("all")).collect()
        if not counted:
            break
        at: dict[int, dict[int, tuple[int, int]]] = {}
        for which, place, p, count in counted:
            at.setdefault(which, {})[place] = (p, count - p)
        p0, n0 = (sum(v[i] for v in at[0].values()) for i in (0, 1))
        if not p0 or not n0:
            break
        best: tuple[float, Condition] | None = None
        for which, name in enumerate(names):
            below_p = below_n = 0
            for place, threshold in enumerate(thresholds[name]):
                p, n = at[which].get(place, (0, 0))
                below_p, below_n = below_p + p, below_n + n
                for above, (a, b) in ((False, (below_p, below_n)), (True, (p0 - below_p, n0 - below_n))):
                    found = (_gain(a, b, p0, n0), Condition(name, above, threshold))
                    if best is None or found[0] > best[0]:
                        best = found
        if best is None or best[0] <= 1e-9:
            break
        rule = (*rule, best[1])
    return rule


def _prune(rows: DataFrame, rule: Rule, precision: float, least: int) -> Rule:
    """The leading conditions that do best on ``rows``, or none."""
    heads = [rule[: i + 1] for i in range(len(rule))]
    got = rows.agg(*[F.struct(F.sum(F.when(covers(h), F.col("bad"))), F.count(F.when(covers(h), 1))).alias(f"h{i}") for i, h in enumerate(heads)]).first()
    best: tuple[float, Rule] = (-1.0, ())
    for head, (p, count) in zip(heads, got):
        if count and p >= least and p >= precision * count and (worth := p - 10 * (count - p)) > best[0]:
            best = (worth, head)
    return best[1]


def judge(stats: DataFrame, rules: Sequence[Rule], least_words: int = 20, repeated_percent: int = 30) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (that rejects it) and ``kept``."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeated_percent * F.col("n_words"))
    return stats.withColumn("base_failed", base).withColumn("rule", rejected_by(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", beside: Sequence[str] = ()) -> DataFrame:
    """Statistics and verdict of every document, the rules learned from ``labels``."""
    stats = durable(statistics(df, id_col, text_col, beside))
    return judge(stats, learn(stats.drop(*beside), labels, id_col))
