"""Nearest neighbours by largest inner product with collision-counting hashing.

Vectors are scaled by the longest one and get one more component that makes all
equally long; queries are scaled to that length. Then the largest inner product is
the smallest distance. A hash function is one random projection. Rows are dealt by
a hash of their id into blocks of about ``block`` rows, queries likewise; every
block of rows meets every block of queries in one task, where each projection is an
array sorted by value. A query opens a window at its own place in every array; the
rows between the window's old and new ends collide once more, all others are not
looked at. Rows that collide in ``threshold`` arrays or more are verified by their
exact inner product. As long as the k-th best verified row is farther away than the
radius the windows stand for, all windows grow by ``growth`` (virtual rehashing: no
array is built again, no row is counted twice in one). A query that is done leaves.

``threshold`` follows from ``miss``: a row at the radius itself fails to reach it
with about that probability, nearer rows with less.

Vectors that are null, zero, or hold null or non-finite components, and rows
without an id, take no part. Vectors of different lengths never meet. Rows with the
query's id are never its candidates; of repeated query ids the smallest vector asks.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def threshold(projections: int, miss: float) -> int:
    """Collisions that a row at the radius reaches but for ``miss``; windows reach one radius to each side."""
    p = 2 * NormalDist().cdf(1.0) - 1
    return max(1, int(projections * p - NormalDist().inv_cdf(1 - miss) * (projections * p * (1 - p)) ** 0.5))


def search_block(rows: np.ndarray, row_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, longest: float, k: int,
                 projections: int, miss: float, growth: float, radius: float, seed: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows of the block: (place of the query, places of rows, inner products)."""
    n, dims = rows.shape
    need = threshold(projections, miss)
    axes = np.random.default_rng(seed).standard_normal((projections, dims + 1))
    unit = rows / longest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (unit**2).sum(axis=1)))
    values = axes[:, :-1] @ unit.T + axes[:, -1:] * rest
    order = np.argsort(values, axis=1)
    values = np.take_along_axis(values, order, axis=1)
    norms = np.sqrt((queries**2).sum(axis=1))
    centres = axes[:, :-1] @ (queries / norms[:, None]).T
    own = np.argsort(row_ids, kind="stable")
    closed = np.zeros((len(queries), n), bool)
    for q, who in enumerate(query_ids):
        closed[q, own[np.searchsorted(row_ids[own], who) : np.searchsorted(row_ids[own], who, "right")]] = True
    here = [np.zeros(0, np.int64) for _ in queries]
    scores = [np.zeros(0) for _ in queries]
    # windows start empty at the query's place in each array; each round counts the rows that enter
    at = np.array([np.searchsorted(v, c) for v, c in zip(values, centres)]).T
    low, high = at.tolist(), at.tolist()
    collisions = np.zeros((len(queries), n), np.uint8 if projections < 256 else np.uint16)
    active, reach = list(range(len(queries))), radius
    while active:
        lo = np.array([np.searchsorted(v, c[active] - reach, "left") for v, c in zip(values, centres)]).T.tolist()
        hi = np.array([np.searchsorted(v, c[active] + reach, "right") for v, c in zip(values, centres)]).T.tolist()
        going = []
        for q, to_low, to_high in zip(active, lo, hi):
            rings = [line[a:b] for line, a, b in zip(order, to_low, low[q])] + [line[a:b] for line, a, b in zip(order, high[q], to_high)]
            entered = np.bincount(np.concatenate(rings), minlength=n)
            collisions[q] += entered.astype(collisions.dtype)
            low[q], high[q] = to_low, to_high
            found = np.flatnonzero((collisions[q] >= need) & ~closed[q])
            if len(found):
                closed[q, found] = True
                # row by row, so that equal vectors get equal numbers
                products = np.einsum("ij,j->i", rows[found], queries[q])
                if len(here[q]) >= k:
                    better = products >= scores[q].min()
                    found, products = found[better], products[better]
                both = np.concatenate([here[q], found]), np.concatenate([scores[q], products])
                best = np.lexsort((row_ids[both[0]], -both[1]))[:k] if len(both[0]) > k else slice(None)
                here[q], scores[q] = both[0][best], both[1][best]
            # distance of the k-th best among unit vectors
            cosine = scores[q].min() / (norms[q] * longest) if len(here[q]) >= k else -1.0
            near = len(here[q]) >= k and np.sqrt(max(0.0, 2 - 2 * cosine)) <= reach
            if not near and sum(to_high) - sum(to_low) < n * projections:
                going.append(q)
        active, reach = going, reach * growth
    out = []
    for q in range(len(queries)):
        best = np.lexsort((row_ids[here[q]], -scores[q]))
        out.append((q, here[q][best], scores[q][best]))
    return out


def search(df: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 64, miss: float = 0.1,
           growth: float = 1.2, radius: float = 0.6, block: int = 8192, query_block: int = 1024, seed: int = 7) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest rows of each row where ``asks``."""
    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), asks.alias("asks"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    good = given.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(~bad).withColumn("length", length).filter((F.col("length") > 0) & (F.col("length") < float("inf")))
    good = good.withColumn("dims", F.size("vector"))
    rows, asked, longest = good.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max("length")).first()
    blocks, query_blocks = max(1, -(-rows // block)), max(1, -(-asked // query_block))

    def dealt(side: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return side.select("dims", "id", "vector", F.pmod(F.xxhash64("id", F.lit(own)), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    asking = good.filter("asks").groupBy("id", "dims").agg(F.min("vector").alias("vector"))
    left = dealt(good, "b", blocks, "c", query_blocks).groupBy("dims", "b", "c")
    right = dealt(asking, "c", query_blocks, "b", blocks).groupBy("dims", "b", "c")

    def work(data: pa.Table, queries: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            vectors = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            return t.column("id").to_numpy(), vectors

        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, vectors = matrix(data)
        query_ids, asked_ = matrix(queries)
        found = search_block(vectors, ids, asked_, query_ids, longest, k, projections, miss, growth, radius, seed)
        who = np.repeat([query_ids[q] for q, _, _ in found], [len(x) for _, x, _ in found])
        return pa.table([who.astype(np.int64), ids[np.concatenate([x for _, x, _ in found])], np.concatenate([s for _, _, s in found])], schema=schema)

    best = left.cogroup(right).applyInArrow(work, "query_id long, vec_id long, score double")
    # at most k rows a block and query
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
