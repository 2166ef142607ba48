"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing.

The tokens of both sides are byte intervals. In a piece of some texts, laid end to
end, all intervals are lexsorted by start, ``maximum.accumulate`` follows their ends,
and a group begins where a start reaches the running maximum. Within the groups the
overlapping pairs (links) are expanded: each A token meets one stretch of B tokens.

Three passes keep it whole at any size:

1. Pieces of texts (*chunks* of ``chunk`` bytes, or one text) are encoded and aligned.
   Per row its groups and, packed, its distinct linked id pairs are written; the last
   row of a chunk holds the chunk's distinct pairs with their numbers.
2. Those, far fewer than the links, are summed by pair. The highest sum of each B id
   (at most as many rows as B has ids, which bounds the broadcast) marks best pairs.
3. Sums go back to the chunks that asked for them; each chunk adds up its rows.

A pair that every chunk holds is asked for once a chunk, not once a link. Written
tables stand between the passes, so a lost executor repeats its tasks of one pass.

Null and empty texts have no tokens, and neither has a text whose joined A or B bytes
differ from space + text (as with a literal U+2581); their numbers are 0 and their
groups empty. Repeated rows and ids (null ones too) each give their own row and count
each. A very long text is a chunk of its own, held by one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .bpe import Merges
from .columns import pieces
from .token_counts import PATTERN

#: Bits of an id in a pair.
_BITS = 20
#: White space in a row that goes to the exact merges.
_RUN = 10_000
_BLANK = regex.compile(rf"\s{{{_RUN}}}")
_PAIRS = "array<struct<pair:bigint,n:bigint>>"


class ByteLevel:
    """Side A: a byte-level BPE file; strings of special tokens count as plain text."""

    def __init__(self, path: str) -> None:
        self.merges = merges = Merges(path)
        letters = {x: b for b, x in enumerate(merges.letters)}
        with open(path, encoding="utf-8") as f:
            special = {t["content"] for t in json.load(f)["added_tokens"]}
        self.size = max(merges.texts) + 1
        self.token_bytes = [b""] * self.size
        for token, number in merges.vocab.items():
            if token not in special:
                self.token_bytes[number] = bytes(letters[x] for x in token)
        ranks = {raw: i for i, raw in enumerate(self.token_bytes) if raw}
        # where merges rank as their ids do, ranks of byte strings say the same as the list of merges
        results = [result & (1 << _BITS) - 1 for result in sorted(merges.pairs.values())]
        self.ranks = ranks if results == sorted(results) and len(set(results)) == len(results) else None
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def _exact(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.merges.encode(w.encode()) for w in regex.findall(PATTERN, text)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranks is None:
            return [self._exact(x) for x in texts]
        self.made = self.made or tiktoken.Encoding("side", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        # the pattern engine of the fast encoder has no room for very long runs of white space
        return [self._exact(x) if len(x) > _RUN and _BLANK.search(x) else self.made.encode_ordinary(x) for x in texts]


class Pieces:
    """Side B: a sentencepiece model, which adds the leading space itself."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.model = f.read()
        self.made = None
        spec = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.size = spec.get_piece_size()
        self.token_bytes = [
            bytes([int(spec.id_to_piece(i)[3:5], 16)]) if spec.is_byte(i) else spec.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)
        ]

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def encode(self, texts: list[str]) -> list[list[int]]:
        self.made = self.made or sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self.made.encode(texts, num_threads=1) if texts else []


def intervals(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of tokens laid end to end."""
    end = np.cumsum(sizes[ids], dtype=np.int64)
    return end - sizes[ids], end


def groups_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B interval, numbered from 0."""
    n = len(a[0])
    start, end = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    side = np.zeros(len(start), np.int8)
    side[n:] = 1
    order = np.lexsort((side, start))
    begins, reached = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = begins[1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group[:n], group[n:]


def links_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs, as places among the A and the B intervals (both ascending and without gaps)."""
    low = np.searchsorted(b[1], a[0], "right")
    count = np.searchsorted(b[0], a[1], "left") - low
    left = np.repeat(np.arange(len(count)), count)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(count) - count - low, count)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by planes of bytes; the upper planes are mostly zero and compress away."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Aligner:
    """Encodes and aligns one chunk; the tables are made on each worker once."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in side.token_bytes], np.int64) for side in (a, b)]
        # text of an id with what follows it: another of its side, the other side, or the next group
        self.shown = [f"{i}{end}" for side, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(side.size)]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        said = [x or "" for x in texts]
        left, right = self.a.encode([" " + x for x in said]), self.b.encode(said)
        byte_a, byte_b = self.a.token_bytes, self.b.token_bytes
        for k, text in enumerate(said):
            whole = b" " + text.encode()
            if not text or b"".join([byte_a[i] for i in left[k]]) != whole or b"".join([byte_b[i] for i in right[k]]) != whole:
                left[k] = right[k] = []
        return left, right

    def rows(self, texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray]:
        """Columns n_a, n_b, n_groups, n_links, groups, held of the texts; the distinct pairs and their numbers."""
        left, right = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (left, right))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(side), np.int64, n.sum()) for side, n in ((left, n_a), (right, n_b)))
        a, b = intervals(ids_a, self.sizes[0]), intervals(ids_b, self.sizes[1])
        group_a, group_b = groups_of(a, b)
        text_a = np.repeat(np.arange(len(texts)), n_a)
        link_a, link_b = links_of(a, b)
        n_links = np.bincount(text_a[link_a], minlength=len(texts))
        firsts = np.flatnonzero(np.diff(group_a, prepend=-1))
        n_groups = np.bincount(text_a[firsts], minlength=len(texts))
        groups = self._shown(ids_a, ids_b, group_a, group_b, n_a + n_b)
        pairs, held = np.unique(ids_a[link_a] << _BITS | ids_b[link_b], return_inverse=True)
        key, n = np.unique(text_a[link_a] * len(pairs) + held, return_counts=True)
        counts = np.bincount(held, minlength=len(pairs))
        # of each text its pairs (steps between their places in the chunk's list) and their numbers
        row, place = key // max(1, len(pairs)), key % max(1, len(pairs))
        step = np.where(np.diff(row, prepend=-1) == 0, np.diff(place, prepend=0), place)
        cut = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        packed = [_planes(np.concatenate([step[x:y], n[x:y]])) for x, y in zip(cut, cut[1:])]
        return [n_a, n_b, n_groups, n_links, groups, packed], pairs, counts

    def _shown(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: np.ndarray) -> list[str]:
        """``a1,a2|b1;...`` of each text; a group's A ids stand before its B ids."""
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
        codes[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")] = ids_a + last_a * self.a.size
        codes[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = ids_b + last_b * self.b.size + 2 * self.a.size
        shown, listed, found, at = self.shown, codes.tolist(), [], 0
        for size in n.tolist():
            found.append("".join([shown[c] for c in listed[at : at + size]])[:-1])
            at += size
        return found


def align(df: DataFrame, a: ByteLevel, b: Pieces, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 20) -> DataFrame:
    """``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups`` of every row, and what ``count_links`` needs.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of each group, A before B. ``held``
    and ``pairs`` are the linked pairs of the row and of its ``chunk``.
    """
    shared = df.sparkSession.sparkContext.broadcast((a, b))
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    pair = pa.struct([("pair", pa.int64()), ("n", pa.int64())])
    made: list[_Aligner] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(_Aligner(*shared.value))
        at = TaskContext.get().partitionId() << 32
        for number, part in enumerate(pieces(batches, 1, chunk)):
            n = part.num_rows
            columns, pairs, counts = made[0].rows(part.column(1).to_pylist())
            listed = pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(counts, pa.int64())], fields=list(pair))
            lists = pa.ListArray.from_arrays(pa.array([0] * n + [len(pairs)], pa.int32()), listed)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.full(n, at + number)), *[pa.array(x, t) for x, t in zip(columns, kinds)], lists],
                ["id", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups", "held", "pairs"],
            )

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, chunk bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, held binary, pairs {_PAIRS}"
    return narrow.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``total`` links corpus-wide, and whether that is its B id's highest: ``best``."""
    totals = durable(aligned.select(F.explode("pairs").alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("total")))
    side = F.col("pair").bitwiseAND((1 << _BITS) - 1)
    # at most one row for each id of B
    highest = totals.groupBy(side.alias("b")).agg(F.max("total").alias("highest"))
    return totals.withColumn("b", side).join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def count_links(aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of its working columns; it must stand in a written table.

    A pair counts how many links of the whole input hold it. ``n_best`` of a row are its
    links whose count is the highest of their B id (ties included), ``count_sum`` sums
    the counts over its links.
    """
    working = ("chunk", "held", "pairs")
    kept = [c for c in aligned.columns if c not in working]
    wanted = aligned.select(F.col("chunk").alias("asked"), F.posexplode("pairs").alias("place", "p")).select("asked", "place", F.col("p.pair").alias("pair"))
    answers = wanted.join(pair_counts(aligned), "pair").select("asked", "place", "total", "best")
    rows = aligned.drop("pairs")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(*kept).schema) + ", n_best bigint, count_sum bigint"

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        place = right.column("place").to_numpy()
        total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        total[place], best[place] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for data in left.column("held").to_pylist():
            step, n = _numbers(data).astype(np.int64).reshape(2, -1)
            at = np.cumsum(step)
            n_best.append(int((best[at] * n).sum()))
            count_sum.append(int((total[at] * n).sum()))
        out = left.select(kept)
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    return rows.groupBy("chunk").cogroup(answers.groupBy("asked")).applyInArrow(work, schema)


def digest(df: DataFrame, a: ByteLevel, b: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All numbers of every row with a hash in place of its groups ('' without tokens)."""
    hashed = F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise("")
    aligned = align(df, a, b, id_col, text_col).withColumn("groups_sha256", hashed).drop("groups")
    counted = count_links(durable(aligned), id_col)
    return counted.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
