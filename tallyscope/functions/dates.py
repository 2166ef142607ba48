"""Financial years, holidays, working days and satellite pass windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Gazetted holidays as (month, day, name).
HOLIDAYS = (
    (1, 26, "Republic Day"),
    (3, 8, "Maha Shivaratri"),
    (3, 25, "Holi"),
    (4, 14, "Dr Ambedkar Jayanti"),
    (4, 17, "Ram Navami"),
    (4, 21, "Mahavir Jayanti"),
    (5, 1, "May Day"),
    (5, 23, "Buddha Purnima"),
    (6, 17, "Eid ul-Fitr"),
    (7, 17, "Muharram"),
    (8, 15, "Independence Day"),
    (8, 26, "Janmashtami"),
    (9, 16, "Milad-un-Nabi"),
    (10, 2, "Gandhi Jayanti"),
    (10, 12, "Dussehra"),
    (10, 24, "Dussehra (additional)"),
    (11, 1, "Diwali"),
    (11, 15, "Guru Nanak Jayanti"),
    (12, 25, "Christmas"),
)
SUNDAY, SATURDAY = 6, 5


def financial_year(day: Column) -> Column:
    """April to March, as ``2024-2025``."""
    start = F.year(day) - F.when(F.month(day) >= 4, 0).otherwise(1)
    return F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))


def financial_year_valid(fy: Column) -> Column:
    """``YYYY-YYYY`` with consecutive years, not before 2006."""
    start = F.regexp_extract(fy, r"^(\d{4})-(\d{4})$", 1).try_cast("int")
    end = F.regexp_extract(fy, r"^(\d{4})-(\d{4})$", 2).try_cast("int")
    return F.coalesce((end == start + 1) & (start >= 2006), F.lit(False))


def financial_year_start(fy: Column) -> Column:
    return F.make_date(F.split(fy, "-")[0].cast("int"), F.lit(4), F.lit(1))


def financial_year_end(fy: Column) -> Column:
    return F.make_date(F.split(fy, "-")[1].cast("int"), F.lit(3), F.lit(31))


def holiday_name(day: Column) -> Column:
    """Holiday of a date, looked up in a constant map by month and day."""
    pairs: list[Column] = []
    for m, d, name in HOLIDAYS:
        pairs += [F.lit(m * 100 + d), F.lit(name)]
    return F.create_map(*pairs)[F.month(day) * 100 + F.day(day)]


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row per holiday and year."""
    names = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("n")) for m, d, n in HOLIDAYS])
    return (
        spark.range(first_year, last_year + 1)
        .select(F.col("id").cast("int").alias("year"), F.explode(names).alias("h"))
        .select("year", F.make_date("year", "h.m", "h.d").alias("holiday"), F.col("h.n").alias("name"))
    )


def non_working_reason(day: Column) -> Column:
    """Sunday, then second/fourth Saturday, then holiday; NULL on working days."""
    nth = F.ceil(F.day(day) / 7)
    return (
        F.when(F.weekday(day) == SUNDAY, "Sunday")
        .when((F.weekday(day) == SATURDAY) & (nth == 2), "2nd Saturday")
        .when((F.weekday(day) == SATURDAY) & (nth == 4), "4th Saturday")
        .otherwise(holiday_name(day))
    )


def is_working_day(
    day: Column, sundays: bool = True, second_saturdays: bool = True, fourth_saturdays: bool = True
) -> Column:
    """Working-day test; each weekly rest rule can be switched off."""
    nth = F.ceil(F.day(day) / 7)
    rest = holiday_name(day).isNotNull()
    if sundays:
        rest = rest | (F.weekday(day) == SUNDAY)
    for on, n in ((second_saturdays, 2), (fourth_saturdays, 4)):
        if on:
            rest = rest | ((F.weekday(day) == SATURDAY) & (nth == n))
    return ~rest


def working_days(start: Column, end: Column, **toggles: bool) -> Column:
    """Working days in ``[start, end]``; the work per row is bounded by its own span."""
    days = F.sequence(start, end)
    return F.size(F.filter(days, lambda d: is_working_day(d, **toggles)))


def pass_windows(
    start: Column, end: Column, before: int = 30, after: int = 30, step: int = 5
) -> Column:
    """Array of (kind, from, to): one window before, steps during, one after."""
    def window(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("window_start"), b.alias("window_end"))

    during = F.when(
        start <= end,
        F.transform(
            F.sequence(start, end, F.expr(f"interval {step} days")),
            lambda d: window("during", d, F.least(F.date_add(d, step - 1), end)),
        ),
    ).otherwise(F.array().cast("array<struct<kind:string,window_start:date,window_end:date>>"))
    return F.concat(
        F.array(window("before", F.date_sub(start, before), F.date_sub(start, 1))),
        during,
        F.array(window("after", F.date_add(end, 1), F.date_add(end, after))),
    )
