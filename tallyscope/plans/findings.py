"""One shape for all findings, with ids that do not change between runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDING = T.StructType([
    T.StructField("finding_id", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("entities", T.ArrayType(T.StringType())),
    T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
    T.StructField("amount", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("action", T.StringType()),
])


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a part lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def findings(
    df: DataFrame,
    category: str,
    *,
    severity: Column | str,
    entities: Sequence[str],
    evidence: Sequence[str] = (),
    amount: Column | None = None,
    confidence: Column | float = 0.0,
    action: str = "",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project a detector's rows to the common finding record."""
    ids = [F.col(c).cast("string") for c in entities]
    pairs: list[Column] = []
    for c in evidence:
        pairs += [F.lit(c), F.col(c).cast("string")]
    facts = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(
        F.sha2(F.concat_ws("|", F.lit(category), *ids, *[F.col(c).cast("string") for c in evidence]), 256).alias("finding_id"),
        F.lit(category).alias("category"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.array_compact(F.array(*ids)).alias("entities"),
        facts.alias("evidence"),
        (amount if amount is not None else F.lit(0.0)).cast("double").alias("amount"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"),
        F.lit(action).alias("action"),
        *keep,
    )
