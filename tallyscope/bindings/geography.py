"""Geo operators on places derived from order and customer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import places
from .base import Tables, query, rnd
from .scalars import spot, spot_sql

_LA, _LO = spot_sql("o_orderkey", 7919, 104729)
_CA, _CO = spot_sql("c_custkey", 31337, 65537)


def order_places(t: Tables) -> DataFrame:
    la, lo = spot("o_orderkey", 7919, 104729)
    return t.orders.select("o_orderkey", la.alias("lat"), lo.alias("lon"))


def customer_squares(t: Tables, dx: float = 0.0, side: float = 0.5) -> DataFrame:
    """A square beside each customer's place, as one closed ring."""
    la, lo = spot("c_custkey", 31337, 65537)
    x0, y0 = lo + dx, la

    def p(x, y):
        return F.array(x, y)

    ring = F.array(p(x0, y0), p(x0 + side, y0), p(x0 + side, y0 + side), p(x0, y0 + side), p(x0, y0))
    return t.customer.select("c_custkey", F.array(ring).alias("rings"))


@query("ge1_bounding_box", f"SELECT o_orderkey, round({_LA} - 500/111320.0::DOUBLE, 8) AS min_lat, round({_LA} + 500/111320.0::DOUBLE, 8) AS max_lat, "
       f"round({_LO} - 500/(111320.0::DOUBLE*cos(radians({_LA}))), 8) AS min_lon, round({_LO} + 500/(111320.0::DOUBLE*cos(radians({_LA}))), 8) AS max_lon FROM orders")
def ge1(t: Tables) -> DataFrame:
    box = geo.bounding_box(F.col("lat"), F.col("lon"), 500)
    return order_places(t).select("o_orderkey", *[rnd(c, 8).alias(n) for n, c in box.items()])


@query("ge2_in_country", f"SELECT o_orderkey, {_LA} BETWEEN 6.5546079 AND 35.6745457 AND {_LO} BETWEEN 68.1113787 AND 97.395561 AS inside FROM orders")
def ge2(t: Tables) -> DataFrame:
    return order_places(t).select("o_orderkey", geo.in_country(F.col("lat"), F.col("lon")).alias("inside"))


@query("ge2_points_in_polygons", f"SELECT o_orderkey, c_custkey FROM orders JOIN customer ON {_LO} > {_CO} + 0.00025 AND {_LO} < {_CO} + 0.50025 AND {_LA} > {_CA} + 0.00025 AND {_LA} < {_CA} + 0.50025")
def ge2_join(t: Tables) -> DataFrame:
    # shifted by a quarter of the coordinate step, so that no point lies on an edge
    la, lo = spot("c_custkey", 31337, 65537)
    x0, y0 = lo + 0.00025, la + 0.00025
    ring = F.array(F.array(x0, y0), F.array(x0 + 0.5, y0), F.array(x0 + 0.5, y0 + 0.5), F.array(x0, y0 + 0.5), F.array(x0, y0))
    polygons = t.customer.select("c_custkey", F.array(ring).alias("rings"))
    return places.points_in_polygons(order_places(t), polygons, cell=0.25).select("o_orderkey", "c_custkey")


def _atanh(x: str) -> str:
    return f"(0.5::DOUBLE*ln((1+{x})/(1-{x})))"


def _sinh(x: str) -> str:
    return f"((exp({x})-exp(-({x})))/2)"


def _cosh(x: str) -> str:
    return f"((exp({x})+exp(-({x})))/2)"


def _utm_sql(source: str, keep: str) -> str:
    """CTE ``u`` with easting and northing of (lat, lon, zone) in ``source``."""
    e = repr(geo._E)
    east = "eta" + "".join(f" + {a!r}*cos({2 * j}*xi)*{_sinh(f'{2 * j}*eta')}" for j, a in enumerate(geo._ALPHA, 1))
    north = "xi" + "".join(f" + {a!r}*sin({2 * j}*xi)*{_cosh(f'{2 * j}*eta')}" for j, a in enumerate(geo._ALPHA, 1))
    k = repr(geo._K0 * geo._BIG_A)
    arg = f"({_atanh('s')} - {e}*{_atanh(f'({e}*s)')})"
    return (
        f"ua AS (SELECT *, sin(radians(lat)) AS s, radians(lon - (zone*6 - 183)) AS dl FROM {source}), ub AS (SELECT *, {_sinh(arg)} AS tt FROM ua), "
        f"uc AS (SELECT *, atan2(tt, cos(dl)) AS xi, {_atanh('(sin(dl)/sqrt(1+tt*tt))')} AS eta FROM ub), "
        f"u AS (SELECT {keep}, zone, 500000 + {k}*({east}) AS easting, {k}*({north}) AS northing FROM uc)"
    )


@query("ge3_utm", f"WITH p AS (SELECT o_orderkey, {_LA} AS lat, {_LO} AS lon FROM orders), z AS (SELECT *, CASE WHEN lon % 6 = 0 THEN CAST(floor((lon+180)/6) AS INTEGER) ELSE CAST(floor((lon+180)/6) AS INTEGER) + 1 END AS zone FROM p), "
       + _utm_sql("z", "o_orderkey") + " SELECT o_orderkey, 32600 + zone AS epsg, round(easting, 3) AS easting, round(northing, 3) AS northing, true AS returns FROM u")
def ge3(t: Tables) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    zone = geo.utm_zone(lon)
    p = order_places(t).withColumns({"zone": zone, "epsg": geo.utm_epsg(lat, lon), "_en": geo.utm_point(lat, lon, zone)})
    p = p.withColumns({"e": F.col("_en")[0], "n": F.col("_en")[1]})
    la, lo = geo.utm_inverse(F.col("e"), F.col("n"), F.col("zone"), F.lit(True))
    back = (F.abs(la - lat) < 1e-7) & (F.abs(lo - lon) < 1e-7)
    return p.select("o_orderkey", "epsg", rnd("e", 3).alias("easting"), rnd("n", 3).alias("northing"), back.alias("returns"))




@query("ge4_polygon_area", f"WITH c AS (SELECT c_custkey, {_CA} AS la, {_CO} AS lo FROM customer), "
       "v AS (SELECT c_custkey, k, la + dy AS lat, lo + dx AS lon, lo + 0.25::DOUBLE AS mid FROM c, (VALUES (0,0.0::DOUBLE,0.0::DOUBLE),(1,0.5::DOUBLE,0.0::DOUBLE),(2,0.5::DOUBLE,0.5::DOUBLE),(3,0.0::DOUBLE,0.5::DOUBLE)) o(k, dx, dy)), "
       "z AS (SELECT *, CAST(floor((mid+180)/6) AS INTEGER) + 1 AS zone FROM v), " + _utm_sql("z", "c_custkey, k")
       + ", e AS (SELECT a.c_custkey, a.easting*b.northing - b.easting*a.northing AS x FROM u a JOIN u b ON a.c_custkey = b.c_custkey AND b.k = (a.k+1) % 4) "
       "SELECT c_custkey, round(abs(sum(x))/2/1e6, 4) AS area_km2 FROM e GROUP BY 1")
def ge4(t: Tables) -> DataFrame:
    return customer_squares(t).select("c_custkey", rnd(geo.polygon_area_m2(F.col("rings")) / 1e6).alias("area_km2"))


@query("ge5_polygon_overlap", "WITH c AS (SELECT c_custkey, c_custkey % 40 / 100.0::DOUBLE AS d, CASE WHEN c_custkey % 3 = 0 THEN 0.0025::DOUBLE ELSE 0 END AS hole FROM customer) SELECT c_custkey, round(100*(0.125::DOUBLE - d*d/2 - hole)/0.125, 6) AS overlap_pct FROM c")
def ge5(t: Tables) -> DataFrame:
    """Squares, some with a hole, and triangles that lean out of them by ever more."""
    la, lo = spot("c_custkey", 31337, 65537)
    d = F.col("c_custkey") % 40 / 100.0

    def ring(*points):
        return F.array(*[F.array(lo + x, la + y) for x, y in (*points, points[0])])

    outer, zero, side = ring((0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)), F.lit(0.0), F.lit(0.5)
    hole = ring((d + 0.05, 0.05), (d + 0.1, 0.05), (d + 0.1, 0.1), (d + 0.05, 0.1))
    square = F.when(F.col("c_custkey") % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    triangle = F.array(ring((d, zero), (d + side, zero), (d, side)))
    pairs = t.customer.select("c_custkey", square.alias("rings"), triangle.alias("other"))
    return places.polygon_overlap(pairs, "c_custkey", "rings", "other").select("c_custkey", rnd("overlap_pct", 6).alias("overlap_pct"))


@query("ge6_centroid", f"SELECT c_custkey, round({_CO} + 0.25, 5) AS lon, round({_CA} + 0.25, 5) AS lat, round({_CO}, 3) AS first_lon FROM customer")
def ge6(t: Tables) -> DataFrame:
    c = customer_squares(t).withColumn("c", geo.ring_centroid(F.col("rings")[0]))
    return c.select("c_custkey", rnd(F.col("c")[0], 5).alias("lon"), rnd(F.col("c")[1], 5).alias("lat"), geo.rounded_rings(F.col("rings"), 3)[0][0][0].alias("first_lon"))
