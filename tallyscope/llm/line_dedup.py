"""Corpus-wide fuzzy line dedup: of each group of similar lines one stays.

Equal lines are one item. Lines of ``n`` characters or more are sets of character
n-grams; MinHash bands propose pairs, exact Jaccard similarity of the sets verifies
them, and union-find makes groups of what is connected. The first occurrence of a
group, by id, hash of the row's text and line number, stays, every other one goes.
Shorter lines only equal themselves. Lines without a character other than white space are never touched.

With 10 bands of 4 values a pair of similarity 0.8 is found with probability 0.995,
one of 0.9 with 0.99997. The n-grams of 7 characters keep lines of one language
apart, whatever their length.

Null texts count as empty. Rows without an id keep all lines, and no line is dropped
in their favour. Rows that share an id are told apart by their texts. Of rows equal in
id and text one is the first; the others lose every line with content. Ids of any
type that can be ordered will do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .columns import mix, packed, pieces
from .pairing import BLOCK, ROWS, if_small, minhash, similar

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_CONTENT = r"[^\x20\x09-\x0D]"


def shingles(texts: list[str], n: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of texts of at least ``n`` characters, and where each text's begin."""
    if n != 7:
        raise ValueError("n-grams of 7 characters are built from pairs and fours")
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code += np.uint64(1)
    two = code[:-1] * _A
    two += code[1:]
    four = two[:-2] * _B
    four += two[2:]
    seven = four[:-3] * _C
    seven += four[3:]
    length = np.array([len(t) for t in texts])
    head = np.cumsum(length) - length
    inside = np.ones(len(code), bool)
    for k in range(1, n):
        inside[head + length - k] = False
    return mix(seven[inside[: len(seven)]]), np.append(0, np.cumsum(length - n + 1))


def signs(lines: list[str], size: int, n: int = 7) -> np.ndarray:
    """MinHash values of lines, taken in blocks that stay in the cache."""
    length = np.cumsum([len(x) for x in lines])
    cuts = np.unique(np.append(np.searchsorted(length, np.arange(BLOCK, length[-1], BLOCK)), len(lines)))
    out = []
    for a, b in zip(np.append(0, cuts[:-1]), cuts):
        if a < b:
            grams, begin = shingles(lines[a:b], n)
            out.append(minhash(grams, begin[:-1], size))
    return np.concatenate(out)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``row`` (a hash of the text) and ``text`` of the rows with an id."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return docs.select("id", F.xxhash64("text").alias("row"), "text")


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 10, n: int = 7) -> DataFrame:
    """The lines that go, for every ``id`` and ``row`` (hash of the text) that loses one.

    ``removed`` are the sorted numbers of lines that the first row of this id and text
    loses, ``again`` those that its ``copies`` - 1 repetitions lose.
    """
    docs = _rows(df, id_col, text_col)
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2):
            at, numbers, lines = [], [], []
            seen: set[str] = set()
            for i, text in enumerate(part.column(2).to_pylist()):
                for number, line in enumerate(text.split("\n")):
                    if len(line) >= n and line not in seen and line.strip("\t\n\v\f\r "):
                        seen.add(line)
                        at.append(i)
                        numbers.append(number)
                        lines.append(line)
            if not lines:
                continue
            equal = [hashlib.md5(x.encode()).digest() for x in lines]
            own = [part.column(k).take(pa.array(at)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int32()), pa.array(equal, pa.binary()), packed(signs(lines, bands * ROWS, n))], ["doc", "row", "line_no", "equal", "sign"])

    signed = docs.mapInArrow(sign, f"doc {kind}, row bigint, line_no int, equal binary, sign binary")
    place = F.struct("doc", "row", "line_no")
    items = signed.groupBy("equal").agg(F.min_by(F.struct("doc", "row", "line_no", "sign"), place).alias("x"))
    # numbers are fixed by the written table
    items = durable(items.select(F.monotonically_increasing_id().alias("id"), "equal", "x.doc", "x.row", "x.line_no", "x.sign"))

    def fetch(wanted: DataFrame, rows: int) -> DataFrame:
        at = items.select("id", "doc", "row", "line_no").join(if_small(wanted, rows), "id", "left_semi").groupBy("doc", "row").agg(F.collect_list(F.struct("line_no", "id")).alias("wanted"))  # lines of one document
        at = if_small(durable(at), rows).withColumnRenamed("doc", "id")
        chosen = docs.join(at, ["id", "row"]).select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
        found = chosen.select(F.col("w.id").alias("id"), F.get("lines", F.col("w.line_no")).alias("text"))
        return found.dropDuplicates(["id"])  # a row may repeat

    def sets(lines: list[str]) -> list[np.ndarray]:
        grams, begin = shingles(lines, n)
        return [grams[a:b] for a, b in zip(begin[:-1], begin[1:])]

    _, linked = similar(items.select("id", "sign"), fetch, sets, bands, threshold)
    fuzzy = items.select("id", "equal").join(linked, "id").select("equal", "component")
    # equal lines: hashes that occur again, with their first occurrence
    all_lines = docs.select("id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(_CONTENT))
    all_lines = all_lines.select("id", "row", "line_no", F.unhex(F.md5("line")).alias("equal"))
    counted = all_lines.groupBy("equal").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").alias("doc"), "row", "line_no")).alias("own"))
    groups = counted.join(fuzzy, "equal", "left").filter((F.col("n") > 1) | F.col("component").isNotNull())
    groups = durable(groups.select("equal", "own", "component"))
    # the first of all lines of a component; items only know the first of a batch
    first = durable(groups.filter("component IS NOT NULL").groupBy("component").agg(F.min("own").alias("first")))
    groups = durable(groups.join(first, "component", "left").select("equal", F.coalesce("first", "own").alias("keep")))
    hits = all_lines.join(if_small(groups, groups.count()), "equal")
    kept = (F.col("id") == F.col("keep.doc")) & (F.col("row") == F.col("keep.row")) & (F.col("line_no") == F.col("keep.line_no"))
    # lines of one document; a repeated row brings each of its lines as often as it occurs
    gone = hits.groupBy("id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("again"), F.sort_array(F.collect_set(F.when(~kept, F.col("line_no")))).alias("removed"), F.count(F.lit(1)).alias("_n"))
    gone = gone.select("id", "row", "removed", "again", F.expr("_n div size(again)").alias("copies"))
    return gone.filter((F.size("removed") > 0) | (F.col("copies") > 1))


def report(df: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_lines`` (with content), ``n_removed`` and ``removed`` of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(_CONTENT)))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), lines.cast("long").alias("n_lines"))
    gone = durable(gone)
    one = docs.join(gone, ["id", "row"], "left").filter("copies IS NULL OR copies = 1")
    one = one.select("id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    # rows that repeat: the first, then all the others
    more = gone.filter("copies > 1").select("id", F.size("again").cast("long").alias("n_lines"), "removed", "again", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("k"))
    more = more.select("id", "n_lines", F.when(F.col("k") == 1, F.col("removed")).otherwise(F.col("again")).alias("removed"))
    return one.unionByName(more).select(F.col("id").alias(id_col), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def apply(df: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the removed lines; rows that have no content left by that are gone too.

    Of rows that repeat an id and text one is left, whatever their other columns hold.
    """
    own = durable(gone.select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.col("removed").alias("_gone"), F.col("copies").alias("_copies")))
    kept = F.transform(
        F.array(F.split(F.col(text_col), "\n")),
        lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: lines[i]), "\n"),
    )[0]
    joined = df.join(own, (F.col(id_col) == own["_id"]) & (F.xxhash64(F.col(text_col).cast("string")) == own["_row"]), "left")
    again = joined.filter("_copies > 1").groupBy("_id", "_row").agg(F.min_by(F.struct(*df.columns, "_gone"), F.xxhash64(*df.columns)).alias("x"))
    rows = joined.filter("_copies IS NULL OR _copies = 1").select(*df.columns, "_gone").unionByName(again.select("x.*"))
    out = rows.withColumn(text_col, F.when(F.coalesce(F.size("_gone"), F.lit(0)) < 1, F.col(text_col)).otherwise(kept))
    return out.filter(F.col("_gone").isNull() | F.col(text_col).rlike(_CONTENT)).select(*df.columns)
