"""Similar sets without all pairs: MinHash bands, tiles, exact checks, union-find.

Items are sets of hashed shingles with a signature of 16-bit MinHash values. Four
values make a band; items that agree in a band share a bucket. A bucket of any size
is cut into tiles by a hash of the item, and a task sees the members of one pair of
tiles at a time, so its memory is bounded by ``TILE`` and no group meets in one task.
A pair is looked at in the first band where it agrees, and nowhere else. A task
emits what it found by item (number of links, smallest item linked to), never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .columns import mix

ROWS = 4
TILE = 256
BLOCK = 1 << 16
#: Groups whose results leave a task in one batch.
TOGETHER = 1000
#: A side of at most so many rows of a few numbers is broadcast; larger ones are shuffled.
SMALL = 2_000_000


def if_small(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= SMALL else side


def minhash(shingles: np.ndarray, first: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """``size`` values of 16 bits for each run of ``shingles`` that begins at ``first``; no run is empty."""
    factors = np.random.default_rng(seed).integers(0, 1 << 31, size).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(first), size), np.uint16)
    # blocks of runs that stay in the cache for all factors
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(shingles), BLOCK)), len(first)))
    for a, b in zip(np.append(0, cuts[:-1]), cuts):
        if a == b:
            continue
        begin, end = first[a], first[b] if b < len(first) else len(shingles)
        low, heads = (shingles[begin:end] >> np.uint64(32)).astype(np.uint32), first[a:b] - begin
        product = np.empty_like(low)
        for k, f in enumerate(factors):
            np.multiply(low, f, out=product)
            # low bits of the smallest product; they are as random as the shingle
            out[a:b, k] = np.minimum.reduceat(product, heads).astype(np.uint16)
    return out


def least_matches(size: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """For each number n of compared values the fewest matches that keep a pair.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1);
    a pair is dropped when the probability of ``threshold`` or more is below ``tolerance``.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(step, size + 1, step):
        for m in range(n + 1):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() >= tolerance * density.sum():
                out.append((n, m))
                break
    return out


Columns = list  # of numpy arrays (integers, null as 0) and lists (everything else)


def _plain(column: pa.Array):
    return column.fill_null(0).to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else column.to_pylist()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[Columns]:
    """Consecutive rows that agree in the first ``keys`` columns, across batches."""
    parts: list[Columns] = []  # of the group that is still open

    def closed() -> Columns:
        if len(parts) == 1:
            return parts[0]
        return [np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part] for c in zip(*parts)]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_plain(c) for c in batch.columns]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if parts and any(parts[-1][k][-1] != columns[k][a] for k in range(keys)):
                yield closed()
                parts = []
            parts.append([c[a:b] for c in columns])
    if parts:
        yield closed()


def _matrix(rows: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def buckets(items: DataFrame, bands: int) -> DataFrame:
    """``bucket``, ``band``, ``id`` and ``members`` of all buckets of two items or more; equal buckets once."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = _matrix(batch.column(1).to_pylist(), np.uint16)[:, : bands * ROWS]
            keys = np.ascontiguousarray(signs).view(np.uint64)
            keys = mix(keys + mix(np.arange(1, bands + 1)))
            where = np.repeat(np.arange(batch.num_rows), bands)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int8), batch.num_rows)), batch.column(0).take(pa.array(where))],
                ["bucket", "band", "id"],
            )

    # one shuffle serves the counts and the join
    rows = items.select("id", "sign").mapInArrow(explode, "bucket long, band byte, id long").repartition("bucket")
    counts = rows.groupBy("bucket").agg(F.min("band").alias("_band"), F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("id")).alias("_xor"), F.sum(F.hash("id").cast("long")).alias("_sum"))
    counts = counts.filter("members > 1")
    # buckets of other bands with the same members: the first band stays
    once = counts.groupBy("members", "_xor", "_sum").agg(F.min(F.struct("_band", "bucket")).alias("b"))
    kept = once.select(F.col("b.bucket").alias("bucket"), "members")
    return rows.join(kept, "bucket")


def candidates(items: DataFrame, members: DataFrame, prune: list[tuple[int, int]]) -> DataFrame:
    """``bucket``, ``lo``, ``hi`` and the candidate pairs of that pair of tiles as two arrays of ids."""
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    own = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    own = own.select("bucket", "band", "id", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = own.select("bucket", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "band", "id")
    signed = dealt.join(items.select("id", "sign"), "id").select("bucket", "lo", "hi", "tile", "band", "id", "sign")
    ordered = signed.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "tile", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def closed() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["bucket", "lo", "hi", "a", "b"])

        for group in _groups(batches, 3):
            bucket, lo, hi, tile, bands_, ids, raw = group
            lo, hi, band, signs = lo[0], hi[0], int(bands_[0]), _matrix(raw, np.uint16)
            second = int(np.searchsorted(tile, hi)) if lo != hi else 0
            left, right = [], []
            for i in range(second if lo != hi else len(ids) - 1):
                begin = second if lo != hi else i + 1
                near = np.arange(begin, len(ids))
                same = signs[near] == signs[i]
                agree = same[:, : (band + 1) * ROWS].reshape(len(near), band + 1, ROWS).all(axis=2)
                keep = agree[:, band] & ~agree[:, :band].any(axis=1) & (ids[near] != ids[i])
                near, same, done, matches = near[keep], same[keep], 0, np.zeros(int(keep.sum()), int)
                for n, least in prune:
                    matches = matches + same[:, done:n].sum(axis=1)
                    keep = matches >= least
                    near, same, matches, done = near[keep], same[keep], matches[keep], n
                left.append(np.full(len(near), ids[i]))
                right.append(ids[near])
            a = np.concatenate(left) if left else np.zeros(0, np.int64)
            if len(a):
                held.append((bucket[0], lo, hi, a, np.concatenate(right)))
            if len(held) >= TOGETHER:
                yield closed()
                held = []
        if held:
            yield closed()

    return ordered.mapInArrow(work, "bucket long, lo int, hi int, a array<long>, b array<long>")


def _parts(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, about ``size`` characters or one text at a time."""
    part, n = [], 0
    for x in texts:
        part.append(x)
        n += len(x)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def verified(pairs: DataFrame, texts: DataFrame, sets: Callable[[list[str]], list[np.ndarray]], threshold: float) -> DataFrame:
    """``id``, ``links`` and ``root`` of each item with a link in a pair of tiles.

    ``texts`` has ``id`` and ``text``; ``sets`` makes the hashed shingles of texts.
    ``root`` is the smallest item of the links' component inside the pair of tiles.
    """
    needed = pairs.select("bucket", "lo", "hi", F.explode(F.array_union("a", "b")).alias("id"))
    none = F.lit(None).cast("array<long>")
    known = needed.join(texts, "id").select("bucket", "lo", "hi", F.lit(1).alias("kind"), "id", "text", none.alias("a"), none.alias("b"))
    asked = pairs.select("bucket", "lo", "hi", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "a", "b")
    both = known.unionByName(asked).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "kind", "id")

    def checked(ids: np.ndarray, raw: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items with a link, their numbers of links and roots, from pairs of places."""
        if len(ids) == 2:
            common = len(np.intersect1d(raw[0], raw[1], assume_unique=True))
            good = common / (len(raw[0]) + len(raw[1]) - common) >= threshold
            return (ids, np.ones(2, np.int64), ids[[0, 0]]) if good else (ids[:0], ids[:0], ids[:0])
        size = np.array([len(x) for x in raw])
        _, codes = np.unique(np.concatenate(raw), return_inverse=True)
        begin = np.cumsum(size) - size
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        mark = np.zeros(int(codes.max()) + 1, np.int32)
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in np.unique(a):
            others = b[np.searchsorted(a, i) : np.searchsorted(a, i, "right")]
            own = codes[begin[i] : begin[i] + size[i]]
            mark[own] = 1
            head = np.cumsum(size[others]) - size[others]
            place = np.repeat(begin[others] - head, size[others]) + np.arange(int(size[others].sum()))
            common = np.add.reduceat(mark[codes[place]], head)
            mark[own] = 0
            good = others[common / (size[i] + size[others] - common) >= threshold]
            links[i] += len(good)
            links[good] += 1
            for j in good:
                x, y = root(int(i)), root(int(j))
                parent[max(x, y)] = min(x, y)
        found = np.flatnonzero(links)
        roots = np.array([root(int(x)) for x in found], np.int64)
        return ids[found], links[found], ids[roots]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            # the shingles of many small groups are made at once
            raw = (np.unique(x) for part in _parts([t for _, texts_, _, _ in held for t in texts_]) for x in sets(part))
            out = [checked(ids, [next(raw) for _ in ids], np.searchsorted(ids, a), np.searchsorted(ids, b)) for ids, _, a, b in held]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["id", "links", "root"])

        for _, _, _, _, ids, texts_, a, b in _groups(batches, 3):
            if len(ids) < 3 or a[0] is None:
                continue
            held.append((ids[1:], texts_[1:], np.array(a[0]), np.array(b[0])))
            size += sum(map(len, texts_[1:]))
            if size >= BLOCK or len(held) >= TOGETHER:
                yield closed()
                held, size = [], 0
        if held:
            yield closed()

    return both.mapInArrow(work, "id long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its smallest id) of all ends of the edges ``id``, ``root``.

    Distributed union-find: each round hooks the neighbours of an item to the smallest
    of them, first those above it, then those below, until nothing moves. A round
    needs minima by key and joins, no list of neighbours; its edges are written to
    the shared folder.
    """

    def hook(pairs: DataFrame, above: bool) -> DataFrame:
        """Pairs are (u, v); for ``above`` in both directions, else with u > v."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(least, "u")
        if above:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))

    now = durable(edges.select(F.greatest("id", "root").alias("u"), F.least("id", "root").alias("v")).filter("u != v").distinct())
    print_ = (0, None)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hook(both, True).filter("u != v").distinct()
        now = durable(hook(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False).filter("u != v").distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == print_:
            break
        print_ = mark
    tops = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)


def similar(items: DataFrame, fetch: Callable[[DataFrame, int], DataFrame], sets: Callable[[list[str]], list[np.ndarray]], bands: int, threshold: float,
            prune: list[tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links of ``items`` (``id``, ``sign``): (``id``, ``links``) and (``id``, ``component``) of linked items.

    ``fetch(ids, rows)`` returns ``id`` and ``text`` of the wanted ids, ``sets`` their shingles.
    """
    pairs = durable(candidates(items, buckets(items, bands), prune or []))
    wanted = durable(pairs.select(F.explode(F.array_union("a", "b")).alias("id")).distinct())
    found = durable(verified(pairs, fetch(wanted, wanted.count()), sets, threshold))
    return found.groupBy("id").agg(F.sum("links").alias("links")), components(found)
