"""Point-in-polygon and polygon overlap over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import common_length, covered, crossing_heights, ring_edges, scanline, spans
from ..session import durable


#: Where in its cell the reference point lies: nowhere that rounded coordinates would put a vertex.
_REF_X, _REF_Y = 0.41421356237, 0.57721566490


def _range(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo).cast("int"), F.floor(hi).cast("int")))


def cover(shapes: DataFrame, shape: str, rings: str, cell: float) -> DataFrame:
    """The cells of each polygon: ``shape``, ``_cx``, ``_cy``, ``_edges``, ``_inside``.

    A cell that a ring passes holds the edges that touch it and whether its reference
    point is inside; a cell without edges lies wholly inside. An edge is listed row of
    cells by row of cells, the inside by the crossings of the rows' reference heights,
    so a polygon is never held by more than one row of its own.
    """
    pad = 1e-9  # of a cell: an edge listed too often does no harm
    edges = shapes.filter(F.col(rings).isNotNull()).select(shape, F.explode(F.flatten(F.transform(rings, ring_edges))).alias("e")).select(
        shape, *[F.col(f"e.{end}")[i].alias(f"{axis}{k}") for end, k in (("a", 1), ("b", 2)) for i, axis in enumerate("xy")])
    edges = edges.withColumns({"_lo": F.least("y1", "y2"), "_hi": F.greatest("y1", "y2")})
    rows = edges.withColumn("_cy", _range(F.col("_lo") / cell - pad, F.col("_hi") / cell + pad))

    def at(y: Column) -> Column:
        return F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.when(F.col("y1") == F.col("y2"), F.lit(1.0)).otherwise(F.col("y2") - F.col("y1"))

    level = F.col("y1") == F.col("y2")
    low, high = at(F.greatest(F.col("_cy") * cell, "_lo")), at(F.least((F.col("_cy") + 1) * cell, "_hi"))
    left = F.when(level, F.least("x1", "x2")).otherwise(F.least(low, high))
    right = F.when(level, F.greatest("x1", "x2")).otherwise(F.greatest(low, high))
    edge = F.struct("x1", "y1", "x2", "y2")
    border = rows.withColumn("_cx", _range(left / cell - pad, right / cell + pad)).select(shape, "_cx", "_cy", edge.alias("_edge"), F.lit(False).alias("_in"))
    height = (F.col("_cy") + _REF_Y) * cell
    hits = rows.filter((F.col("y1") > height) != (F.col("y2") > height)).select(shape, "_cy", at(height).alias("_x"))
    order = W.partitionBy(shape, "_cy").orderBy("_x")  # one row of cells of one polygon
    spans_ = hits.select(shape, "_cy", "_x", F.lead("_x").over(order).alias("_to"), F.row_number().over(order).alias("_n")).filter("_n % 2 = 1")
    x = (F.col("_cx") + _REF_X) * cell
    within = spans_.withColumn("_cx", _range(F.col("_x") / cell - 1, F.col("_to") / cell)).filter((x >= F.col("_x")) & (x < F.col("_to")))
    both = border.unionByName(within.select(shape, "_cx", "_cy", F.lit(None).cast(border.schema["_edge"].dataType).alias("_edge"), F.lit(True).alias("_in")))
    return both.groupBy(shape, "_cx", "_cy").agg(F.collect_list("_edge").alias("_edges"), F.max("_in").alias("_inside"))


#: Edges of a cell that are compared as plain columns; cells of more keep a list.
_FLAT = 4


def _passed(edges: Column, x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    """How many edges the way from (x, y) along the height y to ``to_x`` and on to ``to_y`` crosses."""
    def step(n: Column, e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        across = e["x1"] + dx * (y - e["y1"]) / F.when(dy == 0, F.lit(1.0)).otherwise(dy)
        up = e["y1"] + dy * (to_x - e["x1"]) / F.when(dx == 0, F.lit(1.0)).otherwise(dx)
        first = ((e["y1"] > y) != (e["y2"] > y)) & ((x < across) != (to_x < across))
        second = ((e["x1"] > to_x) != (e["x2"] > to_x)) & ((y < up) != (to_y < up))
        return n + F.when(first, 1).otherwise(0) + F.when(second, 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), step)


def _flat(cells: DataFrame, to_x: Column, to_y: Column) -> tuple[DataFrame, Column]:
    """(cells of few edges with all as columns, whether the point ``lon, lat`` is inside), by the sums of ``_passed``.

    What does not hang on the point is worked out once a cell. No column is null, and
    an edge that is not there crosses nothing.
    """
    columns, inside = {"_tx": to_x, "_in": F.coalesce("_inside", F.lit(False))}, F.col("_in")
    for i in range(_FLAT):
        e = F.get("_edges", F.lit(i))
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        up = e["y1"] + dy * (to_x - e["x1"]) / F.when(dx == 0, F.lit(1.0)).otherwise(dx)
        nan = F.lit(float("nan"))  # lies above all heights
        up = F.coalesce(F.when((e["x1"] > to_x) != (e["x2"] > to_x), up), nan)
        values = {"x": e["x1"], "y": e["y1"], "z": e["y2"], "dx": dx, "dy": F.when(dy == 0, F.lit(1.0)).otherwise(dy)}
        columns |= {f"_{k}{i}": F.coalesce(v, F.lit(1.0 if k == "dy" else 0.0)) for k, v in values.items()}
        columns |= {f"_up{i}": up, f"_below{i}": to_y < up}
        x, y, z, dx, dy = (F.col(f"_{k}{i}") for k in values)
        across = x + dx * (F.col("lat") - y) / dy
        first = ((y > F.col("lat")) != (z > F.col("lat"))) & ((F.col("lon") < across) != (F.col("_tx") < across))
        inside = (inside != first) != ((F.col("lat") < F.col(f"_up{i}")) != F.col(f"_below{i}"))
    kept = [c for c in cells.columns if c not in ("_edges", "_inside")]
    return cells.filter(F.size("_edges") <= _FLAT).select(*kept, *[v.alias(k) for k, v in columns.items()]), inside


def points_in_polygons(points: DataFrame, polygons: DataFrame, rings: str = "rings", cell: float = 0.1) -> DataFrame:
    """Points (``lon, lat``) joined to the polygons that contain them, holes left out.

    A point meets a polygon on its one cell (``cover``). In a cell without edges it is
    inside; in others it is where the reference point is, unless the way there crosses
    an odd number of the cell's edges. Equal polygons are covered once. Points and
    polygons without coordinates meet nothing. The edges of a cell of few are columns,
    since pairs by far outnumber cells and a list is walked pair by pair.
    """
    known = polygons.withColumn("_shape", F.md5(F.to_json(rings)))
    cells = cover(known.groupBy("_shape").agg(F.first(rings).alias(rings)), "_shape", rings, cell).join(known.drop(rings), "_shape")
    placed = points.withColumn("_cx", F.floor(F.col("lon") / cell).cast("int")).withColumn("_cy", F.floor(F.col("lat") / cell).cast("int"))
    # pairs are many where points and cells are few
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, cells = placed.repartition(tasks), durable(cells.repartition(tasks))
    to_x, to_y = (F.col("_cx") + _REF_X) * cell, (F.col("_cy") + _REF_Y) * cell
    crossed = _passed(F.col("_edges"), F.col("lon"), F.col("lat"), to_x, to_y)
    many = (cells.filter(F.size("_edges") > _FLAT), (crossed + F.col("_inside").cast("int")) % 2 == 1)
    kept = [*points.columns, *[c for c in known.columns if c not in (rings, "_shape")]]
    parts = [placed.join(side, ["_cx", "_cy"]).filter(inside).select(*kept) for side, inside in (_flat(cells, to_x, to_y), many)]
    return parts[0].unionByName(parts[1])


def polygon_overlap(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Overlap of two polygons (outer ring and holes, no ring crosses itself) in percent of the smaller one.

    Between two neighbouring heights at which a vertex lies or edges cross, the width of
    either polygon and of what they share is linear, so each such slab counts with its
    height times the width half-way: areas are exact up to rounding. One row a slab.
    """
    def tops(rings: str) -> Column:
        return F.flatten(F.transform(F.col(rings), lambda ring: F.transform(ring, lambda p: p[1])))

    heights = F.array_sort(F.array_distinct(F.concat(tops(a), tops(b), crossing_heights(F.col(a), F.col(b)))))
    slabs = pairs.select(key, a, b, heights.alias("_h")).select(
        key, a, b, F.explode(F.zip_with(F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 1, F.lit(0))), F.slice("_h", F.lit(2), F.greatest(F.size("_h") - 1, F.lit(0))),
                                        lambda lo, hi: F.struct(((lo + hi) / 2).alias("y"), (hi - lo).alias("tall")))).alias("_s"))
    cut = slabs.select(
        key, F.col("_s.tall").alias("_t"), spans(scanline(F.col(a), F.col("_s.y"))).alias("_sa"), spans(scanline(F.col(b), F.col("_s.y"))).alias("_sb")
    )
    sums = cut.groupBy(key).agg(
        F.sum(F.col("_t") * covered(F.col("_sa"))).alias("_a"), F.sum(F.col("_t") * covered(F.col("_sb"))).alias("_b"),
        F.sum(F.col("_t") * common_length(F.col("_sa"), F.col("_sb"))).alias("_both"),
    )
    small = F.least("_a", "_b")
    return sums.select(key, F.when(small > 0, 100 * F.col("_both") / F.when(small > 0, small).otherwise(1.0)).otherwise(0.0).alias("overlap_pct"))
