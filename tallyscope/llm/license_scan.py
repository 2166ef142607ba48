"""License scans: phrases in place, and an exact set-similarity join with notice templates.

Words are runs of characters outside ASCII punctuation, space and control characters;
A-Z count as a-z. A *block* of a text are ``2 * m`` words from a multiple of m on, where
m is the smallest power of two that is no less than a template's number of words, so
every passage of up to m words lies whole in some block. A block meets a template when
it holds at least ``threshold`` of the template's distinct words.

1. One pass counts the words of all templates in the whole corpus; rare words come
   first in the order of all sets.
2. A second pass keeps of each text the words known to templates (others can add
   nothing to an overlap) and joins blocks with templates: blocks of fewer words than
   the least overlap wanted go (length filter); one of the ``size - overlap + 1`` rarest
   words of either side must be shared (prefix filter); the words left behind the first
   shared one must suffice (positional filter); what remains is counted exactly. All
   filters are safe, so every block that meets the threshold is found.

Templates are few and travel to the workers (``most`` bounds their words, more raise an
error); texts are never shuffled, and what a task holds is a piece of its texts.
Words meet by 64-bit hashes of their bytes; places of phrases are compared byte by byte.

Null and empty texts have no words, places or labels, and score 0. Repeated rows and
ids (null ones too) each give their own row and count each in the word counts. Very
long texts are one piece; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import flat, mix, pieces, run_hashes, spans_of

#: Phrases that name a license in passing, and its label (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public notices by label (fixed values); a label may have several. Notices that differ
#: in fewer words than the threshold leaves open share a label.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "gnu-gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3",
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
    ),
    "creative-commons": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "reserved": (
        "All rights reserved",
    ),
}

_BYTES = np.arange(256)
_GAP = (_BYTES <= 0x2F) | (_BYTES >= 0x3A) & (_BYTES <= 0x60) | (_BYTES >= 0x7B) & (_BYTES <= 0x7F)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
_BLOCK = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
_PLACE = pa.struct([("label", pa.string()), ("start", pa.int64())])


class Words:
    """The words of a column of texts: hashes, rows, and numbers within the row."""

    def __init__(self, texts: pa.Array) -> None:
        offsets, data = flat(texts)
        self.data = _LOWER[data]
        self.begin, self.end, self.row = spans_of(offsets, self.data, _GAP)
        self.hash = run_hashes(self.data, self.begin, self.end)
        self.n = np.bincount(self.row, minlength=len(texts))
        self.base = np.cumsum(self.n) - self.n
        self.number = np.arange(len(self.row)) - self.base[self.row]


def _hashes(text: str) -> np.ndarray:
    return Words(pa.array([text])).hash


class Index:
    """Phrases and templates prepared for the workers; ``counts`` are corpus-wide by word hash."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, tuple[str, ...]], threshold: float, most: int) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("a threshold lies above 0, and is 1 at most")
        self.threshold = threshold
        self.labels = sorted({*phrases.values(), *templates})
        self.phrases = [(_hashes(p), p.split(" "), self.labels.index(label)) for p, label in phrases.items()]
        if any(len(words) != len(h) for h, words, _ in self.phrases):
            raise ValueError("a phrase is lower-case words with single spaces")
        self.texts = [(self.labels.index(label), _hashes(x)) for label, texts in templates.items() for x in texts]
        if sum(len(h) for _, h in self.texts) > most:
            raise ValueError(f"templates of more than {most} words")
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for _, h in self.texts]]))

    def ranked(self, counts: Mapping[int, int]) -> Index:
        """The index with its words in ascending order of corpus counts."""
        n = np.array([counts.get(i, 0) for i in range(len(self.known))], np.int64)
        self.rank = np.empty(len(n), np.int64)
        self.rank[np.lexsort((self.known, n))] = np.arange(len(n))
        self.sets, self.classes = [], {}
        for number, (label, hashes) in enumerate(self.texts):
            words = np.sort(self.rank[np.searchsorted(self.known, np.unique(hashes))])
            overlap = int(np.ceil(self.threshold * len(words) - 1e-9))
            m = 1 << max(0, len(hashes) - 1).bit_length()
            self.sets.append((label, words, overlap))
            self.classes.setdefault(m, []).append(number)
        self.member = np.zeros((len(self.sets), max(1, len(n))), bool)
        for number, (_, words, _) in enumerate(self.sets):
            self.member[number, words] = True
        return self

    def words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of words known to templates, and their places in the list of known ones."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, words.hash), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == words.hash)
        return hit, at[hit]


def places(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Word place and label of each phrase that stands in the texts, by place, then label."""
    found = []
    for hashes, parts, label in index.phrases:
        at = np.flatnonzero(words.hash == hashes[0])
        at = at[at + len(parts) <= len(words.hash)]
        at = at[words.row[at] == words.row[at + len(parts) - 1]]
        for k in range(1, len(parts)):
            at = at[words.hash[at + k] == hashes[k]]
        same = [i for i in at.tolist() if all(words.data[words.begin[i + k] : words.end[i + k]].tobytes() == x.encode() for k, x in enumerate(parts))]
        found.append(np.array([[i, label] for i in same], np.int64).reshape(-1, 2))
    rows = np.concatenate([np.zeros((0, 2), np.int64), *found])
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[:, 0], rows[:, 1]


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (count of them), one range after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - low, count)


def blocks(words: Words, index: Index) -> np.ndarray:
    """Rows (text, first word, words, template, overlap) of every block that meets a template."""
    hit, known = index.words(words)
    found, n_known = [np.zeros((0, 5), np.int64)], max(1, len(index.known))
    rank = index.rank[known]
    for m, numbers in index.classes.items():
        least = min(index.sets[t][2] for t in numbers)
        # a word lies in the block that begins in its stretch of m words and in the one before
        stretch = words.number[hit] // m
        most = int(words.n.max(initial=0)) // m + 2
        key = words.row[hit] * most + stretch
        back = stretch > 0
        cell = np.unique(np.concatenate([key, key[back] - 1]) * n_known + np.concatenate([rank, rank[back]]))
        block, word = cell // n_known, cell % n_known
        start = np.flatnonzero(np.diff(block, prepend=-1))
        size = np.diff(np.append(start, len(block)))
        start, size = start[size >= least], size[size >= least]
        if not len(start):
            continue
        # prefixes of templates by word: (template, words behind this one)
        heads = sorted((int(w), t, len(index.sets[t][1]) - k - 1) for t in numbers for k, w in enumerate(index.sets[t][1][: len(index.sets[t][1]) - index.sets[t][2] + 1]))
        head = np.array(heads, np.int64).reshape(-1, 3)
        n = size - least + 1
        at, of = _ranges(start, n), np.repeat(np.arange(len(start)), n)
        low, high = (np.searchsorted(head[:, 0], word[at], side) for side in ("left", "right"))
        pick, many = _ranges(low, high - low), high - low
        of, at, template = np.repeat(of, many), np.repeat(at, many), head[pick, 1]
        overlap = np.array([s[2] for s in index.sets])[template]
        behind = np.minimum(head[pick, 2], start[of] + size[of] - at - 1)
        # of words in rising rank the first shared one decides, so later meetings repeat it
        pair, first = np.unique(of * len(index.sets) + template, return_index=True)
        keep = (1 + behind >= overlap)[first] & (size[of] >= overlap)[first]
        of, template = pair[keep] // len(index.sets), pair[keep] % len(index.sets)
        if not len(of):
            continue
        inside = index.member[np.repeat(template, size[of]), word[_ranges(start[of], size[of])]]
        shared = np.add.reduceat(inside, np.cumsum(size[of]) - size[of], dtype=np.int64)
        good = shared >= np.array([s[2] for s in index.sets])[template]
        where = block[start[of[good]]]
        found.append(np.stack([where // most, where % most * m, np.full(len(where), 2 * m), template[good], shared[good]], axis=1))
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _lists(rows: np.ndarray, n: int, columns: list, kind: pa.StructType) -> pa.ListArray:
    sizes = np.bincount(rows, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind)))


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = 0.8, most: int = 1_000_000,
) -> DataFrame:
    """``id_col``, ``n_words``, ``places`` and ``blocks`` of every row.

    ``places`` are (label, start) of phrases, ``blocks`` (label, start, end, containment)
    of the blocks that meet a template of the label, in words from 0, ends exclusive.
    """
    index = Index(phrases, templates, threshold, most)
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            n = np.bincount(index.words(Words(part.column(0)))[1], minlength=len(index.known))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["word", "n"])

    counted = narrow.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # one row for each word of the templates at most
    shared = df.sparkSession.sparkContext.broadcast(index.ranked({r["word"]: r["n"] for r in counted.collect()}))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        names = np.array(index.labels, object)
        label = np.array([s[0] for s in index.sets], np.int64)
        whole = np.array([len(s[1]) for s in index.sets], np.int64)
        for part in pieces(batches, 1):
            words, n = Words(part.column(1)), part.num_rows
            at, of = places(words, index)
            met = blocks(words, index)
            text, start, template = met[:, 0], met[:, 1], met[:, 3]
            end = np.minimum(start + met[:, 2], words.n[text])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(words.n, pa.int64()),
                    _lists(words.row[at], n, [names[of], words.number[at]], _PLACE),
                    _lists(text, n, [names[label[template]], start, end, met[:, 4] / whole[template]], _BLOCK),
                ],
                ["id", "n_words", "places", "blocks"],
            )

    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, places array<struct<label:string,start:bigint>>, blocks array<struct<label:string,start:bigint,end:bigint,containment:double>>"
    return narrow.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """``found`` with numbers and joined labels in place of places and blocks.

    ``score`` is 1 where a phrase stands, else the highest containment of a template, else 0.
    """
    base, start = F.col("places.label"), F.col("places.start")
    return found.select(
        *[c for c in found.columns if c not in ("places", "blocks")], F.size("places").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("blocks.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )
