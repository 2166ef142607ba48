"""Isolation forest: trees grown per sample group, scored where the rows are."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ordered import quantiles
from ..session import durable


def _path_norm(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def impute_median(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NULL features replaced by the exact median of their column."""
    # a row a feature; together one row that goes to every task
    medians = [quantiles(df, [], f, {f"_m_{f}": 0.5}) for f in features]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), medians)
    filled = {f: F.coalesce(F.col(f).cast("double"), F.col(f"_m_{f}")) for f in features}
    return df.crossJoin(F.broadcast(one)).withColumns(filled).select(*df.columns)


def isolation_forest(
    df: DataFrame, key: str, features: Sequence[str], contamination: float = 0.1, trees: int = 200, sample: int = 256, seed: int = 42
) -> DataFrame:
    """``key, anomaly_score, is_anomaly`` for every row; lower scores are stranger.

    Sampling is the algorithm's own: each tree sees the ``sample`` rows of the whole
    table with the lowest hash of (key, tree). A row is listed only for the trees for
    which its hash is low enough to be among them, with six standard deviations to
    spare. The forest is bounded by ``trees * 2 * sample`` nodes, which is what travels
    to the workers.
    """
    feats = list(features)
    base = durable(impute_median(df.select(key, *feats), feats))
    n = base.count()
    m = min(sample, n)
    rate = min(1.0, (m + 6 * math.sqrt(m) + 10) / max(n, 1))

    def draw(tree: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.col(key), tree, F.lit(seed)), 11) / float(1 << 53)

    low = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < rate)
    listed = base.withColumn("tree", F.explode(low)).withColumn("_u", draw(F.col("tree")))
    rank = F.row_number().over(W.partitionBy("tree").orderBy("_u", key))
    drawn = listed.withColumn("_r", rank).filter(F.col("_r") <= m)
    limit = math.ceil(math.log2(max(m, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iat[0])
        rng = np.random.default_rng(seed * 100_003 + tree)
        x = pdf.sort_values("_r")[feats].to_numpy(float)
        nodes: list[list[float]] = []

        def add(idx: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([tree, me, -1, 0.0, -1, -1, depth + _path_norm(len(idx))])
            if depth >= limit or len(idx) <= 1:
                return me
            lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
            able = np.flatnonzero(hi > lo)
            if len(able) == 0:
                return me
            f = int(rng.choice(able))
            cut = rng.uniform(lo[f], hi[f])
            left = idx[x[idx, f] <= cut]
            right = idx[x[idx, f] > cut]
            nodes[me][2], nodes[me][3] = f, cut
            nodes[me][4] = add(left, depth + 1)
            nodes[me][5] = add(right, depth + 1)
            return me

        add(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "depth"]).astype(
            {"tree": "int32", "node": "int32", "feature": "int32", "low": "int32", "high": "int32"})

    schema = "tree int, node int, feature int, cut double, low int, high int, depth double"
    forest = drawn.groupBy("tree").applyInPandas(grow, schema).orderBy("tree", "node").toPandas()
    grown = [g[["feature", "cut", "low", "high", "depth"]].to_numpy(float) for _, g in forest.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(grown)
    norm = _path_norm(m) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[feats].to_numpy(float)
            total = np.zeros(len(x))
            for t in shared.value:
                at = np.zeros(len(x), int)
                for _ in range(limit):
                    f = t[at, 0].astype(int)
                    inner = f >= 0
                    go_low = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                    at = np.where(inner, np.where(go_low, t[at, 2], t[at, 3]), at).astype(int)
                total += t[at, 4]
            yield pd.DataFrame({key: pdf[key], "_score": -np.power(2.0, -(total / len(shared.value)) / norm)})

    kind = base.schema[key].dataType.simpleString()
    scored = durable(base.mapInPandas(score, f"{key} {kind}, _score double"))
    cut = quantiles(scored, [], "_score", {"_cut": contamination})
    out = scored.crossJoin(F.broadcast(cut))
    return out.select(key, (F.col("_score") - F.col("_cut")).alias("anomaly_score")).withColumn("is_anomaly", F.col("anomaly_score") < 0)
