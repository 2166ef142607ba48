"""Readers of landed files: nested JSON, GeoJSON, open-data pages, HTML, rasters, EXIF."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import safe_float, safe_int, work_id_parts


# -- JSON ---------------------------------------------------------------------------

def read_dataset(spark: SparkSession, path: str, schema: T.StructType) -> dict[str, DataFrame]:
    """One table per top-level array of a dataset document, and one for its national record."""
    doc = spark.read.schema(schema).json(path, multiLine=True)
    out = {}
    for field in schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            out[field.name] = doc.select(F.inline(field.name))
        elif isinstance(field.dataType, T.StructType):
            out[field.name] = doc.select(f"{field.name}.*")
    return out


GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])


def features(docs: DataFrame, column: str, properties: T.StructType) -> DataFrame:
    """Rows of GeoJSON feature collections held in a text column.

    Features without a district and geometries other than polygons are skipped;
    the state code gets two digits. Polygons become a one-element multi-polygon.
    """
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", GEOMETRY)])
    coll = T.StructType([T.StructField("features", T.ArrayType(feature))])
    rows = docs.select(F.inline(F.from_json(column, coll)["features"]))
    kept = rows.filter(
        (F.coalesce(F.col("properties.district"), F.lit("")) != "") & F.col("geometry.type").isin("Polygon", "MultiPolygon")
    )
    ring = "array<array<array<double>>>"
    shape = F.when(
        F.col("geometry.type") == "Polygon", F.array(F.from_json("geometry.coordinates", ring))
    ).otherwise(F.from_json("geometry.coordinates", f"array<{ring}>"))
    return kept.select("properties.*", shape.alias("polygons")).withColumn("st_code", F.lpad("st_code", 2, "0"))


def pick(record: Column, names: Sequence[str]) -> Column:
    """First non-empty value of a ``map<string,string>`` under any alias, ignoring case."""
    low = F.map_from_entries(F.transform(F.map_entries(record), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.coalesce(*[F.nullif(F.trim(low[n.lower()]), F.lit("")) for n in names])


def number(text: Column) -> Column:
    """Number with thousands separators; unreadable text gives NULL."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def open_records(pages: DataFrame, records: str, aliases: Mapping[str, Sequence[str]], numeric: Sequence[str] = ()) -> DataFrame:
    """Records of landed open-data pages under canonical column names."""
    rows = pages.select(F.explode(records).alias("_r"))
    return rows.select(*[(number(pick(F.col("_r"), a)) if n in numeric else pick(F.col("_r"), a)).alias(n) for n, a in aliases.items()])


# -- HTML ---------------------------------------------------------------------------

# Tags with nothing but quoted attributes and no references, as report pages have them, are
# cut at their brackets; a page with anything else goes to the general parser.
_NAME = "(?i:a|b|body|br|center|div|em|font|form|h[1-6]|head|hr|html|i|img|input|label|li|ol|option|p|select|small|span|strong|table|tbody|td|tfoot|th|thead|tr|u|ul)"
_ATTRIBUTE = "[ \\t\\n]+([a-zA-Z][a-zA-Z0-9_-]*)=(?:'([^']*)'|\"([^\"]*)\")"
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_PLAIN = re.compile(f"/({_NAME})[ \\t\\n]*|({_NAME})((?:{re.sub('[(](?![?])', '(?:', _ATTRIBUTE)})*+)[ \\t\\n]*")


@lru_cache(1024)
def _plain_tag(body: str) -> tuple[str, str, list[tuple[str, str]]] | None:
    """Name of an end tag, name and attributes of a start tag, from what stands in the brackets; nothing if it is not plain."""
    found = _PLAIN.fullmatch(body)
    if not found:
        return None
    attrs = [(k.lower(), a or b) for k, a, b in _ATTRIBUTES.findall(found[3])] if found[3] else []
    return (found[1] or "").lower(), (found[2] or "").lower(), attrs


class _Tables(HTMLParser):
    """Collects the tables of a page with their rows and links; nested rows count for both."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.cells: list[list[str]] = []
        self.link: dict | None = None

    def read(self, html: str) -> None:
        if "&" in html or "\r" in html or "\0" in html:
            return self.feed(html)
        before, *pieces = html.split("<")
        steps = []
        for piece in pieces:
            body, bracket, text = piece.partition(">")
            tag = _plain_tag(body) if bracket else None
            if tag is None:
                return self.feed(html)
            steps.append((*tag, text))
        self.handle_data(before)
        for ended, begun, attrs, text in steps:
            if ended:
                self.handle_endtag(ended)
            else:
                self.handle_starttag(begun, attrs)
            if text and (self.cells or self.link is not None):
                self.handle_data(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("td", "th"):
            if self.open and hasattr(self, "row"):
                self.cells.append([])
        elif tag == "table":
            at = dict(attrs)
            table = {"id": at.get("id"), "class": (at.get("class") or "").split(), "rows": [], "links": []}
            self.tables.append(table)
            self.open.append(table)
        elif tag == "tr":
            row: list[str] = []
            for t in self.open:
                t["rows"].append(row)
            self.row = row
        elif tag == "a" and self.open and (href := dict(attrs).get("href")) is not None:
            self.link = {"text": [], "href": href}
            for t in self.open:
                t["links"].append(self.link)

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.cells:
            self.row.append("".join(p.strip() for p in self.cells.pop()))
        elif tag == "a":
            self.link = None

    def handle_data(self, data: str) -> None:
        for cell in self.cells:
            cell.append(data)
        if self.link is not None:
            self.link["text"].append(data)


def _chosen(html: str, table_id: str | None, table_class: str | None) -> dict | None:
    parser = _Tables()
    parser.read(html or "")
    for t in parser.tables:
        if table_id and t["id"] == table_id:
            return t
    for t in parser.tables:
        if table_class and table_class in t["class"]:
            return t
    return max(parser.tables, key=lambda t: len(t["rows"]), default=None)


def _of_pages(pages: DataFrame, key: str, html: str, columns: str, read: Callable[[str | None], list[tuple]]) -> DataFrame:
    """``key`` and the ``columns`` of the rows that ``read`` finds in every page."""
    schema = T.StructType([pages.select(key).schema[0], *T.StructType.fromDDL(columns)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(text) for text in batch.column(1).to_pylist()]
            at = [i for i, rows in enumerate(found) for _ in rows]
            parts = list(zip(*[row for rows in found for row in rows])) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(list(p), k) for p, k in zip(parts, types)]], schema.names)

    types = [{"int": pa.int32(), "string": pa.string()}.get(f.dataType.simpleString(), pa.list_(pa.string())) for f in schema[1:]]
    return pages.select(key, html).mapInArrow(parse, schema)


def html_rows(pages: DataFrame, key: str, html: str, table_id: str | None = None, table_class: str | None = None, skip: int = 1) -> DataFrame:
    """Non-empty rows of the chosen table of every page: ``key, row_no, cells``."""
    def rows(text: str | None) -> list[tuple]:
        table = _chosen(text, table_id, table_class)
        return list(enumerate(r for r in (table["rows"][skip:] if table else []) if any(r)))

    return _of_pages(pages, key, html, "row_no int, cells array<string>", rows)


def html_links(pages: DataFrame, key: str, html: str, table_id: str | None = None, table_class: str | None = None) -> DataFrame:
    """Links inside the chosen table of every page: ``key, text, href``."""
    def links(text: str | None) -> list[tuple]:
        table = _chosen(text, table_id, table_class)
        return [("".join(p.strip() for p in a["text"]), a["href"]) for a in (table["links"] if table else [])]

    return _of_pages(pages, key, html, "text string, href string", links)


# Status words of report pages and the status they stand for.
STATUS_WORDS = (
    ("complete", "completed"), ("ongoing", "ongoing"), ("progress", "ongoing"), ("not started", "not_started"), ("shelved", "shelved"),
)


def _cell(i: int) -> Column:
    """Trimmed cell, empty when the row is shorter."""
    return F.coalesce(F.trim(F.get("cells", F.lit(i))), F.lit(""))


def works_rows(rows: DataFrame, least: int = 6) -> DataFrame:
    """Typed works from positional cells: serial, id, name, type, sanctioned, spent, status, place."""
    low = F.lower(_cell(6))
    status = F.lit("unknown")
    for word, name in reversed(STATUS_WORDS):
        status = F.when(low.contains(word), name).otherwise(status)
    lat, lon = _cell(7).try_cast("double"), _cell(8).try_cast("double")
    known = (F.size("cells") > 8) & lat.isNotNull() & lon.isNotNull()
    base = rows.filter((F.size("cells") >= least) & (_cell(1) != "")).select(
        _cell(1).alias("work_id"), _cell(2).alias("work_name"), _cell(3).alias("work_type"), safe_float(_cell(4)).alias("sanctioned_amount"),
        safe_float(_cell(5)).alias("expenditure"), status.alias("status"), F.when(known, lat).alias("latitude"), F.when(known, lon).alias("longitude"),
    )
    return base.withColumns(work_id_parts(F.col("work_id")))


def muster_rows(rows: DataFrame) -> DataFrame:
    """Typed attendance lines: serial, worker, job card, days, wages, from, to, muster."""
    return rows.filter((F.size("cells") >= 4) & (_cell(1) != "") & (_cell(2) != "")).select(
        _cell(1).alias("worker_name"), _cell(2).alias("job_card_number"), safe_float(_cell(3)).alias("days_worked"), safe_float(_cell(4)).alias("wages_paid"),
        _cell(5).alias("date_from"), _cell(6).alias("date_to"), _cell(7).alias("muster_no"),
    )


def _order_fields(at: int) -> list[Column]:
    names = ("reference_number", "worker_name", "job_card_number", "account_number")
    out = [_cell(at + i).alias(n) for i, n in enumerate(names)]
    return [*out, safe_float(_cell(at + 4)).alias("amount"), _cell(at + 5).alias("status"), _cell(at + 6).alias("transaction_date")]


def order_rows(rows: DataFrame) -> DataFrame:
    """Typed transfer orders from a summary table."""
    return rows.filter(F.size("cells") >= 6).select(_cell(0).alias("fto_no"), *_order_fields(1))


def order_detail_rows(rows: DataFrame, fto: str) -> DataFrame:
    """Typed lines of the detail page of an order held in column ``fto``."""
    return rows.filter(F.size("cells") >= 5).select(F.col(fto).alias("fto_no"), *_order_fields(0))


def worker_rows(rows: DataFrame) -> DataFrame:
    """Typed worker details: the first table row of each page."""
    names = ("worker_name", "relative_name", "age", "gender", "category", "village", "registration_date")
    return rows.filter(F.col("row_no") == 0).select(*[(safe_int(_cell(i)) if n == "age" else _cell(i)).alias(n) for i, n in enumerate(names)])


# -- rasters and EXIF -----------------------------------------------------------------

def band_pixels(chips: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("site_id", "phase")) -> DataFrame:
    """Pixel rows from nested band arrays of equal shape; one chip is one bounded row."""
    lines = F.arrays_zip(*[F.col(b) for b in bands])
    by_row = chips.select(*keys, F.posexplode(lines).alias("row", "_l"))
    cells = F.arrays_zip(*[F.col("_l")[b].alias(b) for b in bands])
    return by_row.select(*keys, "row", F.posexplode(cells).alias("col", "_c")).select(*keys, "row", "col", *[F.col("_c")[b].alias(b) for b in bands])


def repeat_coarse(fine: DataFrame, coarse: DataFrame, band: str, keys: Sequence[str] = ("site_id", "phase"), factor: int = 2) -> DataFrame:
    """Add a band of ``factor`` times coarser pixels to the fine grid."""
    up = coarse.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), band)
    tagged = fine.withColumn("_r", F.floor(F.col("row") / factor).cast("int")).withColumn("_c", F.floor(F.col("col") / factor).cast("int"))
    return tagged.join(up, [*keys, "_r", "_c"], "left").drop("_r", "_c")


def exif_time(text: Column) -> Column:
    """Timestamp in any of the three spellings cameras use."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")])


def exif_degrees(deg: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    value = deg + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)
