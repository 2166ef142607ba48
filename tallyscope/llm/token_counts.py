"""Token counts of whole texts with the whole-token shortcut.

Before any text is read, every string of the vocabulary is put through the
pre-tokenizer and the merges. Those that come out as one pre-token and one token
are *whole*: where a pre-token equals one, it counts as 1 without merging. Only
other pre-tokens are merged, exactly, by rank.

Texts are cut at single spaces and line feeds first, where cutting cannot change
a pre-token; texts with other white space in a row or at an edge go through the
pre-tokenizer's pattern as they are. Strings of added tokens inside a text count
as that token, as is the tokenizer's default. Null counts as empty, with 0 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, Merges
from .columns import pieces

#: Pre-tokens of byte-level vocabularies (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that a cut at single spaces or line feeds would treat wrongly.
_UNEVEN = regex.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")


class Counter:
    """Counts tokens; built from the tables on each worker once."""

    def __init__(self, merges: Merges, whole: frozenset[str], most: int) -> None:
        self.merges, self.whole, self.pattern = merges, whole, regex.compile(PATTERN)
        self.chunks = Memo(self._chunk, most)

    def _chunk(self, chunk: str) -> int:
        """Tokens of a text that is pre-tokenized on its own."""
        if chunk in self.whole:
            return 1
        return sum(1 if t in self.whole else len(self.merges.encode(t.encode())) for t in self.pattern.findall(chunk))

    def _uneven(self, text: str) -> int:
        return sum(self.chunks[t] for t in self.pattern.findall(text))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if any(t in text for t in self.merges.added):
            return sum(self._uneven(part) + (added is not None) for part, added in self.merges.segments(text))
        if _UNEVEN.search(text):
            return self._uneven(text)
        get, lines = self.chunks.__getitem__, text.split("\n")
        total = get("\n") * (len(lines) - 1)
        for line in lines:
            head, *rest = line.split(" ")
            total += get(head) + sum(map(get, [" " + x for x in rest]))
        return total


def whole_tokens(merges: Merges) -> frozenset[str]:
    """Vocabulary strings proved to be one pre-token and one token."""
    letters = {x: b for b, x in enumerate(merges.letters)}
    pattern, proved = regex.compile(PATTERN), set()
    for token, number in merges.vocab.items():
        raw = bytes(letters[x] for x in token)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue  # a part of a character is never a pre-token
        if pattern.findall(text) == [text] and merges.encode(raw) == [number]:
            proved.add(text)
    return frozenset(proved)


class _Tables:
    """What travels to the workers; the counter is made there and kept as long as the worker."""

    def __init__(self, merges: Merges, whole: frozenset[str], most: int) -> None:
        self.parts, self.made = (merges, whole, most), None

    def __getstate__(self):
        return {"parts": self.parts, "made": None}

    def counter(self) -> Counter:
        self.made = self.made or Counter(*self.parts)
        return self.made


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, remembered: int = 600_000) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    ``vocabulary`` is the path of the tokenizer file, read on the driver only.
    ``remembered`` bounds a worker's memory of chunks and changes no result.
    """
    merges = Merges(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(_Tables(merges, whole_tokens(merges), remembered))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value.counter()
        for part in pieces(batches, 1):
            n = [counter.count(x or "") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    narrow = narrow.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return narrow.mapInArrow(work, schema).withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
