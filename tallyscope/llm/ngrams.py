"""Interpolated modified Kneser-Ney trigrams over all words, in sharded tables.

Words are 64-bit hashes, so there is no vocabulary to hold: every word, bigram and
trigram of the training texts is a row of one table that grows with them. A row has
the gram's count (trigrams) or number of different words before it (shorter grams),
and, as a context, the total and the numbers of counts 1, 2 and 3 or more of what
follows. Only the discounts and the sums over all words are single numbers. A word
that was never seen has the probability of one unseen type.

To score, a task turns about ``chunk`` bytes of texts into one row of words. Each
chunk asks each shard once for its distinct grams; a shard answers chunk by chunk,
in the order it was asked, and the chunk adds up its documents' log probabilities.
Shards are ranges of the gram's hash, more of them for larger tables, so that no
word and no language meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .columns import flat, mix, pieces, run_hashes, spans_of
from .pairing import _groups

_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: Stands for the two words before a text.
BEGIN = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0xD1342543DE82EF95)
#: Least number of shards, as a power of two, and rows from which there are more.
BITS, ROWS = 10, 1 << 20
_VALUES = ["n", "total", "n1", "n2", "n3"]
_TABLE = "shard long, key long, " + ", ".join(f"{c} long" for c in _VALUES)


def hashed(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows in order, and how many each row has."""
    start, end, row = spans_of(offsets, data, _BLANK)
    return run_hashes(data, start, end), np.bincount(row, minlength=len(offsets) - 1)


def before(words: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """The word ``k`` places before each word of its row, or BEGIN."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    out = np.full(len(words), BEGIN)
    inside = np.flatnonzero(place >= k)
    out[inside] = words[inside - k]
    return out


def one(w: np.ndarray) -> np.ndarray:
    return mix(w + _STEP)


def longer(head: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Key of the gram of key ``head`` followed by word ``w``."""
    return mix(head * _STEP + w)


def keys(words: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of the trigram, bigram and word that end at each place, and of the contexts of the first two."""
    v, u = before(words, count, 1), before(words, count, 2)
    first, pair = one(v), longer(one(u), v)
    return longer(pair, words), longer(first, words), one(words), pair, first


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2, 3 and more, from the number of counts 1 to 4."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [1, 2, 3])])


@dataclass(frozen=True)
class Model:
    """Single numbers of the model: discounts of orders 1 to 3, words, their predecessors, weight of the uniform."""

    discount: np.ndarray
    types: int
    total: int
    uniform: float
    bits: int

    def _order(self, n: np.ndarray, context: list[np.ndarray], order: int, under: np.ndarray) -> np.ndarray:
        d, (total, *ns) = self.discount[order - 1], context
        seen = np.maximum(total, 1)
        rest = np.where(total > 0, sum(d[i + 1] * ns[i] for i in range(3)) / seen, 1.0)
        return np.maximum(n - d[np.minimum(n, 3)], 0.0) / seen + rest * under

    def log_probability(self, asked: np.ndarray, values: np.ndarray, words: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each word; ``values`` are the table's five numbers of the sorted keys ``asked``."""
        k3, k2, k1, pair, first = (np.searchsorted(asked, k) for k in keys(words, count))
        d, n = self.discount[0], values[0]
        p = np.maximum(n[k1] - d[np.minimum(n[k1], 3)], 0.0) / max(self.total, 1) + self.uniform / (self.types + 1)
        p = self._order(n[k2], [v[first] for v in values[1:]], 2, p)
        return np.log(self._order(n[k3], [v[pair] for v in values[1:]], 3, p))


def asked_of(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The distinct keys that a chunk needs, in order."""
    return np.unique(np.concatenate(keys(words, count)))


def _context(n: str) -> list:
    c = F.col(n)
    return [F.sum(c).alias("total"), F.count(F.when(c == 1, 1)).alias("n1"), F.count(F.when(c == 2, 1)).alias("n2"), F.count(F.when(c >= 3, 1)).alias("n3")]


def _discounts(counts: DataFrame) -> np.ndarray:
    of = dict(tuple(r) for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1))).collect())
    return discounts(np.array([of.get(i, 0) for i in (1, 2, 3, 4)]))


def train(trusted: DataFrame) -> tuple[Model, DataFrame]:
    """The model's numbers and the distributed table of all grams of the column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0, 4 << 20):
            words, size = hashed(*flat(part.column(0)))
            if not len(words):
                continue
            _, at, n = np.unique(keys(words, size)[0], return_index=True, return_counts=True)
            gram = [before(words, size, k)[at].view(np.int64) for k in (2, 1)] + [words[at].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in [*gram, n.astype(np.int64)]], ["u", "v", "w", "n"])

    threes = durable(trusted.select("text").mapInArrow(count, "u long, v long, w long, n long").groupBy("u", "v", "w").agg(F.sum("n").alias("n")))
    twos = durable(threes.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n")))
    ones = durable(twos.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    sums = ones.agg(F.count(F.lit(1)).alias("types"), *_context("n")).first()
    discount = np.array([_discounts(x) for x in (ones, twos, threes)])
    total = sums.total or 0
    uniform = float(np.dot(discount[0][1:], [sums.n1, sums.n2, sums.n3])) / total if total else 1.0
    none, no = F.lit(None).cast("long"), F.lit(0).cast("long")
    grams = [threes.select("u", "v", "w", "n", *[no.alias(c) for c in _VALUES[1:]]),
             twos.select(none.alias("u"), "v", "w", "n", *[no.alias(c) for c in _VALUES[1:]]),
             ones.select(none.alias("u"), none.alias("v"), "w", "n", *[no.alias(c) for c in _VALUES[1:]]),
             threes.groupBy("u", "v").agg(*_context("n")).select(none.alias("u"), F.col("u").alias("v"), F.col("v").alias("w"), no.alias("n"), *_VALUES[1:]),
             twos.groupBy("v").agg(*_context("n")).select(none.alias("u"), none.alias("v"), F.col("v").alias("w"), no.alias("n"), *_VALUES[1:])]
    rows = grams[0]
    for g in grams[1:]:
        rows = rows.unionByName(g)
    bits = max(BITS, int(np.ceil(np.log2(max(threes.count() / ROWS, 1)))))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = 3 - batch.column(0).is_null().to_numpy(False).astype(int) - batch.column(1).is_null().to_numpy(False)
            u, v, w = (batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in range(3))
            head = np.where(size == 3, longer(one(u), v), one(v))
            key = np.where(size == 1, one(w), longer(head, w))
            shard = (key >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key.view(np.int64)), *batch.columns[3:]], ["shard", "key", *_VALUES])

    return Model(discount, sums.types, total, uniform, bits), durable(rows.mapInArrow(keyed, _TABLE))


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers by place of the byte, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def score(docs: DataFrame, model: Model, table: DataFrame, chunk: int = 4 << 20) -> DataFrame:
    """``id``, ``lang``, ``words`` and ``log_probability`` of every row of ``docs`` (``id``, ``text``, ``lang``)."""
    bits = model.bits

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            # ids and languages as one Arrow stream
            names, press = pa.BufferOutputStream(), zstandard.ZstdCompressor(3)
            with pa.ipc.new_stream(names, held[0][0].schema) as out:
                for batch, _, _ in held:
                    out.write_batch(batch)
            words, count = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            kinds, index = np.unique(words, return_inverse=True)
            packed = [press.compress(x) for x in (names.getvalue().to_pybytes(), count.astype("<i4").tobytes(), kinds.tobytes(), index.astype("<u4").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([place]), *[pa.array([x], pa.binary()) for x in packed]], ["chunk", "rows", "count", "kinds", "words"])

        size = 0
        for part in pieces(batches, 1):
            offsets, data = flat(part.column(1))
            held.append((part.select([0, 2]), *hashed(offsets, data)))
            size += len(data)
            if size >= chunk:
                yield closed()
                held, size, place = [], 0, place + 1
        if held:
            yield closed()

    # written once: the two uses below must see the same chunks
    parts = "rows binary, count binary, kinds binary, words binary"
    chunks = durable(docs.select("id", "text", "lang").mapInArrow(number, f"chunk long, {parts}"))

    def opened(packed: list[bytes]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        names, count, kinds, index = map(zstandard.ZstdDecompressor().decompress, packed)
        return pa.ipc.open_stream(names).read_all(), np.frombuffer(count, "<i4").astype(np.int64), np.frombuffer(kinds, np.uint64)[np.frombuffer(index, "<u4")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, count, words = opened([batch.column(c)[i].as_py() for c in (1, 2, 3, 4)])
                asked = asked_of(words, count)
                shard = (asked >> np.uint64(64 - bits)).astype(np.int64)
                shards, at = np.unique(shard, return_index=True)
                steps = np.diff(asked, prepend=np.uint64(0))
                steps[at] = asked[at]
                blobs = [_pack(steps[a:b]) for a, b in zip(at, np.append(at[1:], len(asked)))]
                place = np.full(len(shards), batch.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(place), pa.array(blobs, pa.binary())], ["shard", "chunk", "part"])

    no = F.lit(None).cast("long")
    requests = chunks.mapInArrow(ask, "shard long, chunk long, part binary")
    both = table.select("shard", F.lit(-1).cast("long").alias("chunk"), "key", *_VALUES, F.lit(None).cast("binary").alias("part")).unionByName(
        requests.select("shard", "chunk", no.alias("key"), *[no.alias(c) for c in _VALUES], "part"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a shard's rows come first, then what the chunks ask of it
        now, held, known, values = None, [], np.zeros(0, np.uint64), np.zeros((5, 0), np.int64)
        for batch in batches:
            shard, place = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((np.diff(shard) != 0) | ((place[1:] < 0) != (place[:-1] < 0))) + 1
            out: list[list] = [[], [], []]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if shard[a] != now:
                    now, held, known, values = shard[a], [], np.zeros(0, np.uint64), np.zeros((5, 0), np.int64)
                if place[a] < 0:
                    held.append(np.array([batch.column(c).slice(a, b - a).to_numpy() for c in range(2, 8)]))
                    continue
                if held:
                    rows = np.concatenate(held, axis=1)
                    rows = rows[:, np.argsort(rows[0].view(np.uint64), kind="stable")]
                    # a gram and the same words as a context are two rows
                    known, at = np.unique(rows[0].view(np.uint64), return_index=True)
                    values, held = np.add.reduceat(rows[1:], at, axis=1), []
                for i in range(a, b):
                    keys_ = np.cumsum(_unpack(batch.column(8)[i].as_py(), np.uint64), dtype=np.uint64)
                    found = np.zeros((5, len(keys_)), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, keys_), len(known) - 1)
                        found = np.where(known[at] == keys_, values[:, at], 0)
                    for x, y in zip(out, (place[i], shard[i], _pack(np.ascontiguousarray(found).ravel()))):
                        x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["chunk", "shard", "part"])

    answers = both.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(answer, "chunk long, shard long, part binary")
    blank = F.lit(None).cast("binary")
    names = ["rows", "count", "kinds", "words"]
    back = chunks.select("chunk", F.lit(-1).cast("long").alias("shard"), *names, blank.alias("part")).unionByName(
        answers.select("chunk", "shard", *[blank.alias(c) for c in names], "part"))
    ordered = back.repartition("chunk").sortWithinPartitions("chunk", "shard")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            rows, count, words = opened([group[c][0] for c in (2, 3, 4, 5)])
            found = [_unpack(x, np.int64).reshape(5, -1) for x in group[6][1:]]
            values = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
            logs = model.log_probability(asked_of(words, count), values, words, count) if len(words) else np.zeros(0)
            sums = np.bincount(np.repeat(np.arange(len(count)), count), logs, len(count)).astype(float)
            known = [rows.column(c).combine_chunks() for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*known, pa.array(count, pa.int64()), pa.array(sums, pa.float64())], ["id", "lang", "words", "log_probability"])

    return ordered.mapInArrow(add_up, "id long, lang string, words long, log_probability double")
