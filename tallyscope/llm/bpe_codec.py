"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Words of all documents are counted by Spark. Those that make up at least
``frequent`` of all words (so at most ``1 / frequent`` words, whatever the input)
are encoded once and compiled into a minimal acyclic automaton: words enter in
sorted order, and states with the same continuations become one. A move carries a
number, and the numbers along a word add up to its rank, which addresses its token
ids. The automaton is a flat file in the cluster's shared folder that Spark
distributes and workers map into memory. Words that it does not hold are merged
exactly, so the results do not depend on the counts.

Null counts as empty, which has no tokens. Strings of added tokens become these
tokens.
"""

from __future__ import annotations

import hashlib
import mmap
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, shared_folder
from .bpe import Memo, Merges
from .columns import pieces

#: The vocabulary's pre-tokens (fixed value of its file); what lies between them is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def normalise(text: str) -> str:
    """NFC, then each character in lower case by itself."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if text.isascii() else "".join([c.lower() for c in text])


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton of ``words`` as one file: header, moves, final flags, and token ids by rank.

    States are numbered so that a state's moves lie together: ``first`` has the
    place of the first one, ``labels`` the byte, ``targets`` the next state and
    ``adds`` how many words sort before those behind the move.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    below: list[int] = []  # words behind each state

    def settle(node: list) -> int:
        """The registered state with this node's continuations."""
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            below.append(node[0] + sum(below[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[False, []]]  # unsettled nodes of the last word: final, moves
    last = b""
    for word in sorted(words):
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
    root = settle(path[0])
    first, labels, targets, adds = [0], bytearray(), [], []
    for final, moves in states:
        count = int(final)
        for label, to in moves:
            labels.append(label)
            targets.append(to)
            adds.append(count)
            count += below[to]
        first.append(len(labels))
    ids = [words[w] for w in sorted(words)]
    where = np.cumsum([0, *map(len, ids)]).astype("<u4")
    flat = np.array([x for one in ids for x in one], "<u4")
    pad = -len(labels) % 4
    finals = bytes(f for f, _ in states)
    finals += bytes(-len(finals) % 4)
    head = struct.pack("<6I", root, len(states), len(labels), len(ids), len(flat), len(finals))
    return b"".join([
        head, np.array(first, "<u4").tobytes(), np.array(targets, "<u4").tobytes(), np.array(adds, "<u4").tobytes(),
        where.tobytes(), flat.tobytes(), finals, bytes(labels) + bytes(pad),
    ])


_BYTES = [bytes((b,)) for b in range(256)]


class Lexicon:
    """Looks words up in a compiled file without loading it."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, states, moves, words, ids, finals = struct.unpack_from("<6I", self.map)
        view, at = memoryview(self.map), 24
        parts = []
        for n in (states + 1, moves, moves, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.adds, self.where, self.ids = parts
        self.finals = view[at : at + finals]
        self.labels = at + finals

    def get(self, word: bytes) -> list[int] | None:
        state, rank, base, seek = self.root, 0, self.labels, self.map.find
        for b in word:
            lo, hi = self.first[state], self.first[state + 1]
            move = seek(_BYTES[b], base + lo, base + hi)
            if move < 0:
                return None
            move -= base
            rank += self.adds[move]
            state = self.targets[move]
        return self.ids[self.where[rank] : self.where[rank + 1]].tolist() if self.finals[state] else None


class Codec:
    """Encodes and decodes with the tables of one tokenizer.

    Words are remembered as decimal ids and decoded text, whatever stands around them.
    """

    def __init__(self, merges: Merges, lexicon: Lexicon | None, most: int = 300_000) -> None:
        self.merges, self.lexicon = merges, lexicon
        self.pattern, self.words = regex.compile(PATTERN), Memo(self._word, most)

    def ids(self, word: str) -> list[int]:
        """Token ids of one normalised pre-token: from the lexicon, or merged."""
        raw = word.encode()
        known = self.lexicon.get(raw) if self.lexicon else None
        return self.merges.encode(raw) if known is None else known

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: tokens, word ends included, joined by spaces."""
        return " ".join([self.merges.texts[i] for i in ids])

    def _word(self, word: str) -> tuple[str, str]:
        ids = self.ids(word)
        return " ".join(map(str, ids)), self.decode(ids)

    def _parts(self, text: str) -> list[tuple[str, str]]:
        known = self.words.__getitem__
        if not any(t in text for t in self.merges.added):
            return list(map(known, self.pattern.findall(normalise(text))))
        parts = []
        for plain, added in self.merges.segments(text):
            parts += map(known, self.pattern.findall(normalise(plain)))
            if added is not None:
                parts.append((str(added), self.merges.texts[added]))
        return parts

    def both(self, text: str) -> tuple[str, str, int]:
        """Decimal ids, decoded text and number of tokens."""
        parts = [p for p in self._parts(text) if p[0]]
        ids = " ".join([p[0] for p in parts])
        return ids, " ".join([p[1] for p in parts]), ids.count(" ") + 1 if ids else 0


class _Tables:
    """What travels to the workers; the codec is made there and kept as long as the worker."""

    def __init__(self, merges: Merges, file: str, most: int) -> None:
        self.parts, self.made = (merges, file, most), None

    def __getstate__(self):
        return {"parts": self.parts, "made": None}

    def codec(self) -> Codec:
        if self.made is None:
            merges, file, most = self.parts
            self.made = Codec(merges, Lexicon(SparkFiles.get(file)), most)
        return self.made


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Runs of letters in lower case, counted over all texts: ``word`` and ``n``."""
    words = df.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+")).alias("word"))
    return words.filter("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def frequent_words(counts: DataFrame, frequent: float) -> list[str]:
    """Words that make up at least ``frequent`` of all: no more than ``1 / frequent``.

    A word longer than 64 letters is left to the merges.
    """
    kept = durable(counts.filter((F.col("n") > 1) & (F.length("word") <= 64)))
    total = kept.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in kept.filter(F.col("n") >= F.lit(max(2.0, frequent * total))).select("word").collect()]


def _place(spark: SparkSession, data: bytes) -> str:
    """Put a file into the shared folder and let Spark distribute it; returns its name."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", frequent: float = 1e-5, remembered: int = 300_000) -> DataFrame:
    """``id_col``, ``ids`` (decimal, joined by spaces), ``decoded`` and ``n_tokens`` of every row.

    ``vocabulary`` is the path of the tokenizer file, read on the driver only.
    ``frequent`` (a share of all words that occur twice or more) and ``remembered``
    (words that a worker keeps) change the speed, never a result.
    """
    spark, merges = df.sparkSession, Merges(vocabulary)
    words = {w.encode(): merges.encode(w.encode()) for w in map(normalise, frequent_words(word_counts(df, text_col), frequent))}
    shared = spark.sparkContext.broadcast(_Tables(merges, _place(spark, compile_lexicon(words)), remembered))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for part in pieces(batches, 1):
            ids, texts, counts = zip(*[codec.both(x or "") for x in part.column(1).to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids), pa.array(texts), pa.array(counts, pa.int64())], ["id", "ids", "decoded", "n_tokens"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, ids string, decoded string, n_tokens long"
    return narrow.mapInArrow(work, schema).withColumnRenamed("id", id_col)
