"""Numbers, money text, bands, ids and record checks as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAKH = 100_000
CRORE = 10_000_000


# -- first digits ---------------------------------------------------------

def first_digit_text(value: Column) -> Column:
    """Leading digit of the ten-decimal text after one run of zeros is removed.

    Numbers below 0.1 whose first decimal is zero give NULL, as do zero and NaN.
    """
    v = F.abs(value.cast("double"))
    text = F.when(
        v < 1e8, F.format_string("%.10f", v)
    ).otherwise(F.floor(v).cast("decimal(38,0)").cast("string"))
    stripped = F.regexp_replace(text, r"^0*\.?", "")
    digit = F.substring(stripped, 1, 1).cast("int")
    return F.when((v > 0) & ~F.isnan(v) & (digit >= 1), digit)


def first_digit_whole(value: Column) -> Column:
    """Leading digit of the whole part; numbers below one give NULL."""
    v = F.floor(F.abs(value.cast("double")))
    return F.when(v >= 1, F.substring(v.cast("string"), 1, 1).cast("int"))


def first_digit_strict(value: Column) -> Column:
    """True leading significant digit at any magnitude."""
    v = F.abs(value.cast("double"))
    return F.when((v > 0) & ~F.isnan(v), F.substring(F.format_string("%.9e", v), 1, 1).cast("int"))


# -- bands ----------------------------------------------------------------

def risk_band(score: Column, critical: float = 75, high: float = 55, medium: float = 35) -> Column:
    return (
        F.when(score >= critical, "critical")
        .when(score >= high, "high")
        .when(score >= medium, "medium")
        .otherwise("low")
    )


def tier(score: Column, high: float = 0.75, medium: float = 0.50) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "critical", 0).when(severity == "high", 1)
        .when(severity == "medium", 2).when(severity == "low", 3).otherwise(4)
    )


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


# -- money text -----------------------------------------------------------

def indian_grouping(value: Column) -> Column:
    """Thousands, then pairs of digits: ``9876543`` -> ``98,76,543``.

    Two decimals, rounded half up, only when the fraction is above half a paisa; a
    fraction that rounds to 100 carries into the whole part.
    """
    v = F.abs(value.cast("double"))
    some = v - F.floor(v) > 0.005
    exact = F.when(some, F.round(v, 2).cast("decimal(38,2)")).otherwise(F.floor(v).cast("decimal(38,2)")).cast("string")
    whole, cents = F.substring_index(exact, ".", 1), F.substring_index(exact, ".", -1)
    head = F.when(F.length(whole) > 3, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(F.lit(""))
    tail = F.when(F.length(whole) > 3, F.right(whole, F.lit(3))).otherwise(whole)
    pairs = F.regexp_replace(F.reverse(head), r"(\d{2})(?=\d)", "$1,")
    grouped = F.when(F.length(head) > 0, F.concat(F.reverse(pairs), F.lit(","), tail)).otherwise(tail)
    body = F.when(some, F.concat(grouped, F.lit("."), cents)).otherwise(grouped)
    return F.when(value < 0, F.concat(F.lit("-"), body)).otherwise(body)


def inr(value: Column) -> Column:
    return F.concat(F.lit("Rs "), indian_grouping(value))


def _hundredths(value: Column) -> Column:
    """Two decimals, rounded half up on the double ``100 * value`` itself, as SQL engines round doubles."""
    return F.round(value * 100) / 100


def to_lakhs(value: Column) -> Column:
    return _hundredths(value / LAKH)


def to_crores(value: Column) -> Column:
    return _hundredths(value / CRORE)


def _plain(value: Column) -> Column:
    """A number of two decimals without exponent; a second zero is left out."""
    return F.regexp_replace(value.cast("decimal(38,2)").cast("string"), "0$", "")


def human_amount(value: Column) -> Column:
    """Crore and lakh text for large amounts, grouped rupees otherwise."""
    size = F.abs(value)
    return (
        F.when(size >= CRORE, F.concat(F.lit("Rs "), _plain(to_crores(value)), F.lit(" Cr")))
        .when(size >= LAKH, F.concat(F.lit("Rs "), _plain(to_lakhs(value)), F.lit(" L")))
        .otherwise(inr(value))
    )


# -- parsing --------------------------------------------------------------

def safe_float(text: Column) -> Column:
    """Digits, points and minus signs only; anything unreadable is 0."""
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\d.\-]", "")
    return F.coalesce(cleaned.try_cast("double"), F.lit(0.0))


def safe_int(text: Column) -> Column:
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\d]", "")
    return F.coalesce(cleaned.try_cast("long"), F.lit(0).cast("long"))


def location_code(text: Column) -> Column:
    """First run of four or more digits, else the trimmed text."""
    found = F.regexp_extract(text, r"(\d{4,})", 1)
    return F.when(found != "", found).otherwise(F.trim(text))


def work_id_parts(work_id: Column) -> dict[str, Column]:
    """State, district, block and panchayat codes of ``SS/DDDD/BBB/PPP/..``."""
    parts = F.split(work_id, "/")
    blank = {"state_code": "00", "district_code": "0000", "block_code": "000", "panchayat_code": "000"}
    return {
        name: F.when((F.size(parts) >= 4) & (F.get(parts, F.lit(i)) != ""), F.get(parts, F.lit(i))).otherwise(zero)
        for i, (name, zero) in enumerate(blank.items())
    }


def masked_account(account: Column) -> Column:
    return F.concat(F.substring(account, 1, 6), F.lit("***"))


# -- hashes ---------------------------------------------------------------

def hash64(hex_text: Column) -> Column:
    """Signed 64-bit number of a 16-digit hex hash."""
    return F.conv(hex_text, 16, -10).cast("bigint")


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_hamming(a: Column, b: Column) -> Column:
    """Bit distance of two hex hashes; unequal lengths count as fully different."""
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b)) * 4).otherwise(
        hamming64(hash64(a), hash64(b))
    )


# -- record checks --------------------------------------------------------

def bounds_problems(
    lat: str, lon: str, positive: Sequence[str] = (), not_negative: Sequence[str] = ()
) -> Column:
    """Names of the fields of a record outside their permitted range."""
    def bad(cond: Column, name: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(name))

    checks = [
        bad(~F.col(lat).between(6.0, 37.0), lat),
        bad(~F.col(lon).between(68.0, 98.0), lon),
        *[bad(F.col(c).isNull() | (F.col(c) <= 0), c) for c in positive],
        *[bad(F.col(c) < 0, c) for c in not_negative],
    ]
    return F.array_compact(F.array(*checks))


def split_valid(df: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows for quarantine, the latter with their reasons."""
    marked = df.withColumn("problems", problems)
    return (
        marked.filter(F.size("problems") == 0).drop("problems"),
        marked.filter(F.size("problems") > 0),
    )
