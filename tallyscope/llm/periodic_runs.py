"""Periodic runs of words, found with suffix trees.

A *run* is a stretch of consecutive words with smallest period q and at least
``max(least, times * q)`` words that neither neighbouring word extends.

1. A run of period q and length m has m - q words that recur at distance q, 16 or
   more with the default limits (``window_words``). Each of its words lies in a window
   of so many words that occurs twice in the run. Stretches of words covered by such
   windows are cut out first; a run never leaves its stretch, so none is lost. Texts
   without a stretch need no tree.
2. Stretches of a few texts, parted by symbols that occur once, get two suffix trees
   by Ukkonen's algorithm, one of the sequence and one of its reversal. An Euler tour
   of each tree and block-wise range minima give the lowest common ancestor of two
   leaves, hence the longest common extension of two places, in constant time.
3. Every run holds a Lyndon root that is the longest Lyndon word at its place in the
   order of the symbols or in the reversed order: it ends where the next smaller
   suffix begins. These (at most two a place) are extended in both directions; those
   that reach the wanted length are the runs, their period is smallest because a
   Lyndon word has no shorter period.

Only the rows of a piece are in memory; a text is never cut, so a task needs memory in
proportion to its longest text. Nothing is shuffled, a lost executor costs its tasks.

Null and empty texts, and texts of white space only, have no words, no runs and an
empty collapsed text. Rows are judged one by one: repeated rows and ids (null ones
too) each give their own row. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import flat, mix, pieces, run_hashes, spans_of

#: White space between words: space and 0x09-0x0D.
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Symbols that share a pair of trees; a longer stretch has a pair of its own.
_TREE = 40_000


class Extensions:
    """Longest common extensions of places in a sequence: Ukkonen's tree, Euler tour, range minima.

    ``symbols`` are ints below ``width``; the last one occurs once.
    """

    def __init__(self, symbols: list[int], width: int) -> None:
        self.n, self.width = len(symbols), width
        self._grow(symbols)
        keys = np.fromiter(self.edges.keys(), np.int64, len(self.edges))
        self.to = np.fromiter(self.edges.values(), np.int64, len(self.edges))
        del self.edges
        self.parent, self.letter = keys // width, keys % width
        tour = self._tour()
        self.first = np.zeros(len(self.depth), np.int64)
        self.first[tour[::-1]] = np.arange(len(tour) - 1, -1, -1)
        self._minima(np.asarray(self.depth, np.int32)[tour])

    def _grow(self, s: list[int]) -> None:
        n, width = self.n, self.width
        edges: dict[int, int] = {}
        start, end, link, depth, leaf = [0], [0], [0], [0], [-1]
        node = at = length = rest = 0
        for i, c in enumerate(s):
            rest += 1
            made = 0
            while rest:
                if not length:
                    at = i
                key = node * width + s[at]
                below = edges.get(key, 0)
                if below:
                    size = (end[below] if end[below] <= i else i + 1) - start[below]
                    if length >= size:
                        at, length, node = at + size, length - size, below
                        continue
                    if s[start[below] + length] == c:
                        if made:
                            link[made] = node
                        length += 1
                        break
                    split = len(start)
                    edges[key] = split
                    start += (start[below], i)
                    end += (start[below] + length, n)
                    link += (0, 0)
                    depth += (rest - 1, n - i + rest - 1)
                    leaf += (-1, i - rest + 1)
                    edges[split * width + c] = split + 1
                    start[below] += length
                    edges[split * width + s[start[below]]] = below
                    if made:
                        link[made] = split
                    made = split
                else:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    depth.append(n - i + rest - 1)
                    leaf.append(i - rest + 1)
                    if made:
                        link[made] = node
                        made = 0
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - rest + 1
        self.edges, self.depth, self.suffix = edges, depth, np.asarray(leaf, np.int64)
        self.leaf = np.zeros(n, np.int64)
        ends = np.flatnonzero(self.suffix >= 0)
        self.leaf[self.suffix[ends]] = ends

    def _children(self, order: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """First and last place of each node's children among all, and the children, in ``order`` of letters."""
        by = np.argsort(self.parent * self.width + order[self.letter])
        count = np.bincount(self.parent, minlength=len(self.depth))
        last = np.cumsum(count)
        return (last - count).tolist(), last.tolist(), self.to[by].tolist()

    def _tour(self) -> np.ndarray:
        at, last, child = self._children(np.arange(self.width))
        path, tour = [0], [0]
        while path:
            v = path[-1]
            k = at[v]
            if k == last[v]:
                path.pop()
                if path:
                    tour.append(path[-1])
                continue
            at[v] = k + 1
            c = child[k]
            tour.append(c)
            if at[c] == last[c]:
                tour.append(v)
            else:
                path.append(c)
        return np.asarray(tour, np.int64)

    def ranks(self, order: np.ndarray) -> np.ndarray:
        """The place of each suffix among all sorted ones, letters in the given order."""
        at, last, child = self._children(order)
        stack, found = [0], []
        while stack:
            v = stack.pop()
            if at[v] == last[v]:
                found.append(v)
            else:
                stack += child[at[v] : last[v]][::-1]
        rank = np.zeros(self.n, np.int64)
        rank[self.suffix[found]] = np.arange(self.n)
        return rank

    def _minima(self, depth: np.ndarray, size: int = 32) -> None:
        blocks = -(-len(depth) // size)
        padded = np.full(blocks * size, np.iinfo(np.int32).max, np.int32)
        padded[: len(depth)] = depth
        table = padded.reshape(blocks, size)
        self.size, self.tour_depth = size, padded
        self.from_left = np.minimum.accumulate(table, axis=1).ravel()
        self.to_right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [table.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= blocks:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j``, which differ."""
        a, b = self.first[self.leaf[i]], self.first[self.leaf[j]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        block_a, block_b = a // self.size, b // self.size
        least = np.minimum(self.to_right[a], self.from_left[b])
        inner = block_b - block_a - 1
        far = np.flatnonzero(inner > 0)
        level = np.frexp(inner[far].astype(np.float64))[1] - 1
        for k in np.unique(level):
            rows = far[level == k]
            low = self.levels[k]
            least[rows] = np.minimum(least[rows], np.minimum(low[block_a[rows] + 1], low[block_b[rows] - (1 << k)]))
        near = np.flatnonzero(inner < 0)
        if len(near):
            within = self.tour_depth[a[near]]
            for step in range(1, self.size):
                within = np.minimum(within, self.tour_depth[np.minimum(a[near] + step, b[near])])
            least[near] = within
        return least.astype(np.int64)


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of smaller rank (the number of places if none)."""
    n, values = len(rank), rank.tolist()
    found, open_ = [n] * n, []
    for i, r in enumerate(values):
        while open_ and values[open_[-1]] > r:
            found[open_.pop()] = i
        open_.append(i)
    return np.asarray(found, np.int64)


def runs_of(stretches: list[list], least: int = 24, times: int = 3) -> list[np.ndarray]:
    """The runs of each sequence of hashable items: rows (start, length, period) by start, then period."""
    marks = len(stretches) + 1
    names: dict = {}
    symbols, bounds = [0], [1]
    for k, items in enumerate(stretches):
        symbols += [names.setdefault(x, len(names) + marks) for x in items]
        symbols.append(k + 1)
        bounds.append(len(symbols))
    n, width = len(symbols), len(names) + marks
    ahead, back = Extensions(symbols, width), Extensions(symbols[::-1], width)
    order = np.arange(width)
    turned = np.where(order < marks, order, marks + width - 1 - order)
    place, found = np.flatnonzero(np.asarray(symbols) >= marks), []
    for letters in (order, turned):
        end = _next_smaller(ahead.ranks(letters))[place]
        period = end - place
        right = ahead.common(place, end)
        left = back.common(n - place, n - end)
        length = left + period + right
        good = length >= np.maximum(least, times * period)
        found.append(np.stack([place[good] - left[good], length[good], period[good]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    cut = np.searchsorted(rows[:, 0], bounds)
    return [rows[a:b] - [bounds[k], 0, 0] for k, (a, b) in enumerate(zip(cut, cut[1:]))]


def window_words(least: int, times: int) -> int:
    """Words that some window of every run repeats at the distance of its period."""
    # length - q of the shortest run of period q, smallest over all q
    return min(max(least, times * q) - q for q in range(1, least + 1))


def _twice(key: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def stretches_of(words: np.ndarray, rows: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Spans of places that may hold runs; ``words`` are hashes, ``rows`` the (ascending) row of each."""
    w = window_words(least, times)
    if len(words) < least:
        return []
    # hash of the w words from each place on, by doubling
    made, size, window = 0, 1, None
    single = mix(words)
    while made < w:
        if (w - made) & size:
            part = single[made : len(words) - size + 1]
            window = part if window is None else mix(window[: len(part)] * np.uint64(3)) + part
            made += size
        if made < w:
            single = mix(single[:-size] * np.uint64(5)) + single[size:]
            size *= 2
    count = len(words) - w + 1
    window = window[:count]
    inside = np.flatnonzero(rows[:count] == rows[w - 1 :])
    group = rows[inside].astype(np.uint64)
    spans: list[tuple[int, int]] = []
    for _ in range(2):  # repeats within a row, then within a stretch
        inside = inside[_twice(mix(window[inside] + mix(group + np.uint64(7))))]
        if not len(inside):
            return []
        new = np.flatnonzero((inside[1:] > inside[:-1] + w) | (rows[inside[1:]] != rows[inside[:-1]])) + 1
        first, last = inside[np.concatenate([[0], new])], inside[np.concatenate([new - 1, [len(inside) - 1]])] + w
        spans = [(a, b) for a, b in zip(first.tolist(), last.tolist()) if b - a >= least]
        group = np.repeat(np.arange(len(first)), np.diff(np.concatenate([[0], new, [len(inside)]]))).astype(np.uint64)
    return spans


def _rows(texts: pa.Array, least: int, times: int) -> tuple[list[np.ndarray | None], list[bytes], np.ndarray]:
    """Runs (None without), collapsed text and number of words of each text."""
    offsets, data = flat(texts)
    begin, end, row = spans_of(offsets, data, _GAP)
    spans = stretches_of(run_hashes(data, begin, end), row, least, times)
    n = np.bincount(row, minlength=len(texts))
    base = np.cumsum(n) - n
    raw = data.tobytes()
    words = [raw[a:b].split() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    runs: list[np.ndarray | None] = [None] * len(texts)
    waiting: list[tuple[int, int, list]] = []
    held = 0

    def settle() -> None:
        for (k, at, _), found in zip(waiting, runs_of([x[2] for x in waiting], least, times)):
            if len(found):
                found = found + [at, 0, 0]
                runs[k] = found if runs[k] is None else np.concatenate([runs[k], found])
        waiting.clear()

    for a, b in spans:
        k = int(row[a])
        at = a - int(base[k])
        if waiting and held + b - a > _TREE:
            settle()
            held = 0
        waiting.append((k, at, words[k][at : at + b - a]))
        held += b - a
    if waiting:
        settle()
    for k, found in enumerate(runs):
        if found is not None:
            drop = np.zeros(len(words[k]) + 1, np.int64)
            np.add.at(drop, found[:, 0] + found[:, 2], 1)
            np.add.at(drop, found[:, 0] + found[:, 1], -1)
            words[k] = [words[k][i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0)]
    return runs, [b" ".join(x) for x in words], n


def _first(found: np.ndarray) -> list[int]:
    """The run of greatest length / period; of equal ones that of smallest start, then period."""
    best = found[0].tolist()
    for start, length, period in found[1:].tolist():
        if length * best[2] > best[1] * period:
            best = [start, length, period]
    return best


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``id_col``, ``n_words``, ``runs``, ``strongest`` and ``collapsed`` of every row.

    ``runs`` are (start, length, period) by start, then period, in words from 0;
    ``strongest`` is the one of greatest length / period (null without runs).
    ``collapsed`` are the words, joined by one space, without those that some run
    holds after its first period.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has at least two periods")
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            runs, collapsed, n = _rows(part.column(1), least, times)
            sizes = [0 if x is None else len(x) for x in runs]
            some = [x for x in runs if x is not None]
            flat_runs = np.concatenate(some) if some else np.zeros((0, 3), np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat_runs[:, c])) for c in range(3)], fields=list(_RUN)),
            )
            best = pa.array([None if x is None else dict(zip(("start", "length", "period"), _first(x))) for x in runs], _RUN)
            text = pa.array(collapsed, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), lists, best, text], ["id", "n_words", "runs", "strongest", "collapsed"])

    run = "struct<start:bigint,length:bigint,period:bigint>"
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(work, f"id {kind}, n_words bigint, runs array<{run}>, strongest {run}, collapsed string").withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """``found`` with counts and hashes in place of runs and texts."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    best = F.col("strongest")
    milli = F.expr("(1000 * strongest.length) div strongest.period")
    return found.select(
        *[c for c in found.columns if c not in ("n_words", "runs", "strongest", "collapsed")], F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), milli.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
