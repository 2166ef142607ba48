"""Filtered, sorted and paged reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import severity_rank

# Columns of the list views (activity is the caller's flag column).
DISTRICT_SUMMARY = (
    "id", "district_code", "district_name", "state_code", "state_name", "state_type", "region", "lat", "lng",
    "total_works", "total_expenditure_lakhs", "verified_count", "flagged_count", "anomalies_count",
    "estimated_leakage_lakhs", "risk_score", "risk_band", "person_days", "active_workers", "total_households",
    "completion_rate_pct",
)
STATE_SUMMARY = (
    "id", "state_code", "state_name", "state_type", "region", "avg_wage_rate", "total_districts",
    "active_districts", "total_works", "total_expenditure_lakhs", "person_days", "verified_count",
    "flagged_count", "anomalies_count", "estimated_leakage_lakhs", "risk_score", "risk_band",
    "total_households", "active_workers", "completion_rate_pct",
)


def contains(col: str, text: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(F.col(col)).contains(text.lower())


def _all(conds: Sequence[Column | None]) -> Column:
    out = F.lit(True)
    for c in conds:
        if c is not None:
            out = out & c
    return out


def search_areas(
    df: DataFrame,
    *,
    code: str = "state_code",
    names: Sequence[str] = ("district_name", "state_name"),
    state_name: str = "state_name",
    state: str | None = None,
    exact: Mapping[str, str | None] | None = None,
    active: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Areas by state code or name part, exact attributes, activity and free text."""
    conds: list[Column | None] = []
    if state:
        conds.append((F.col(code).cast("string") == state) | contains(state_name, state))
    for col, want in (exact or {}).items():
        if want is not None:
            conds.append(F.lower(F.col(col)) == want.lower())
    if active:
        conds.append(F.col(active))
    if search:
        hit = F.lit(False)
        for n in names:
            hit = hit | contains(n, search)
        conds.append(hit)
    return df.filter(_all(conds))


def search_records(
    df: DataFrame,
    *,
    parts: Mapping[str, str | None] | None = None,
    exact: Mapping[str, Any] | None = None,
    ranges: Mapping[str, tuple[Any, Any]] | None = None,
) -> DataFrame:
    """Records by name parts, exact attributes and ranges inclusive at both ends."""
    conds: list[Column | None] = [contains(c, v) for c, v in (parts or {}).items() if v]
    conds += [F.col(c) == v for c, v in (exact or {}).items() if v is not None]
    for c, (low, high) in (ranges or {}).items():
        if low is not None:
            conds.append(F.col(c) >= low)
        if high is not None:
            conds.append(F.col(c) <= high)
    return df.filter(_all(conds))


def newest_first(df: DataFrame, when: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(when).desc(), F.col(tie))


def summary(df: DataFrame, columns: Sequence[str] = DISTRICT_SUMMARY, *extra: str) -> DataFrame:
    """The list-view columns; those a table lacks come out NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in (*columns, *extra)])


def sort_by(df: DataFrame, key: str, tie: str, order: str = "desc") -> DataFrame:
    """Sort by any column; the id breaks ties, so that pages never overlap."""
    col = F.col(key)
    return df.orderBy(col.desc_nulls_last() if order == "desc" else col.asc_nulls_last(), F.col(tie))


def page(df: DataFrame, key: str, tie: str, skip: int, limit: int, order: str = "desc") -> DataFrame:
    """One page; Spark keeps only ``skip + limit`` rows per task."""
    return sort_by(df, key, tie, order).offset(skip).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def by_severity(df: DataFrame, severity: str, amount: str, tie: str) -> DataFrame:
    """Most severe first, then by amount."""
    return df.orderBy(severity_rank(F.col(severity)), F.col(amount).desc(), F.col(tie))


def with_children(
    parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str], name: str = "children"
) -> DataFrame:
    """Parent records with their children nested in id order.

    Meant for administrative levels, whose fan-out is fixed by geography.
    """
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(nested, key, "left").withColumn(
        name, F.coalesce(name, F.array().cast(nested.schema[name].dataType))
    )


def bound_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], **params: Any) -> DataFrame:
    """Parameterised SQL over given DataFrames, with bound values."""
    return spark.sql(sql, args=params, **tables)
