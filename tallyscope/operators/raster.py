"""Raster operators over pixel tables of many sites.

Pixel table: ``site_id, phase, row, col`` and one column per band. A mask is the
table of its set pixels plus the grid size: ``site_id, row, col, height, width``.
Per-pixel arithmetic stays in Columns. Neighbourhood work is done on tiles of fixed
size with a margin, so that one group never exceeds a tile whatever a site holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ordered import quantiles
from ..session import durable

# Scene classes hidden before analysis (no data, defective, cloud
# shadow, clouds of medium and high probability, cirrus, snow).
HIDDEN_CLASSES = (0, 1, 3, 8, 9, 10, 11)
PIXEL_KEY = ("site_id", "row", "col")
TILE = 128


# -- per-pixel arithmetic ----------------------------------------------------------

def mask_clouds(px: DataFrame, bands: Sequence[str], scl: str = "scl") -> DataFrame:
    hidden = F.col(scl).isin(*HIDDEN_CLASSES)
    return px.withColumns({b: F.when(~hidden, F.col(b)) for b in bands})


def ratio_index(num: Column, den: Column, style: str = "zero") -> Column:
    """Normalised difference; ``style`` says what an empty denominator gives.

    ``zero``: 0 where it is zero. ``positive``: 0 unless positive, clipped.
    ``epsilon``: divided by 1e-10 instead, clipped.
    """
    if style == "zero":
        return F.when(den != 0, num / den).when(den == 0, 0.0)
    if style == "positive":
        return F.when(den > 0, F.least(F.greatest(num / den, F.lit(-1.0)), F.lit(1.0))).when(den <= 0, 0.0)
    if style == "epsilon":
        safe = F.when(den == 0, 1e-10).otherwise(den)
        return F.least(F.greatest(num / safe, F.lit(-1.0)), F.lit(1.0))
    raise ValueError(style)


def indices(px: DataFrame, style: str = "zero") -> DataFrame:
    """Vegetation, water, bare-soil and burn index of every pixel."""
    b, g, r, n, s = (F.col(c) for c in ("blue", "green", "red", "nir", "swir"))
    return px.withColumns({
        "ndvi": ratio_index(n - r, n + r, style), "ndwi": ratio_index(g - n, g + n, style),
        "bsi": ratio_index((s + r) - (n + b), (s + r) + (n + b), style), "nbr": ratio_index(n - s, n + s, style),
    })


def changes(px: DataFrame, names: Sequence[str] = ("ndvi", "ndwi", "bsi")) -> DataFrame:
    """Before, after and difference per pixel: one pivoting aggregate, no self-join."""
    aggs: list[Column] = []
    for n in names:
        for phase in ("before", "after"):
            aggs.append(F.max(F.when(F.col("phase") == phase, F.col(n))).alias(f"{n}_{phase}"))
    out = px.groupBy(*PIXEL_KEY).agg(*aggs)
    return out.withColumns({f"d_{n}": F.col(f"{n}_after") - F.col(f"{n}_before") for n in names})


def exceeds(diff: Column, threshold: float) -> Column:
    """Absolute change above a threshold; unknown counts as no change."""
    return F.coalesce(F.abs(diff) > threshold, F.lit(False))


def classified_changes(
    ch: DataFrame, composite: float = 0.15, veg: float = 0.15, water: float = 0.20, soil: float = 0.12
) -> DataFrame:
    """Change mask, the three specific masks and the class of every pixel."""
    size = F.sqrt(F.pow("d_ndvi", F.lit(2)) + F.pow("d_ndwi", F.lit(2)) + F.pow("d_bsi", F.lit(2)))
    no = F.lit(False)
    out = ch.withColumns({
        "changed": F.coalesce(size > composite, no), "veg_loss": F.coalesce(F.col("d_ndvi") < -abs(veg), no),
        "new_water": F.coalesce(F.col("d_ndwi") > water, no), "soil_disturbed": F.coalesce(F.col("d_bsi") > soil, no),
    })
    hits = F.col("veg_loss").cast("int") + F.col("new_water").cast("int") + F.col("soil_disturbed").cast("int")
    kind = (
        F.when(~F.col("changed"), "NO_CHANGE").when(hits > 1, "MIXED_CHANGE").when(F.col("veg_loss"), "VEGETATION_CLEARED")
        .when(F.col("new_water"), "WATER_BODY_CREATED").when(F.col("soil_disturbed"), "SOIL_DISTURBANCE").otherwise("UNCLASSIFIED")
    )
    return out.withColumn("change_type", kind)


def change_statistics(df: DataFrame, changed: str, valid: Column | None = None, resolution: float = 10.0) -> DataFrame:
    """Pixels, share and area of change per site."""
    ok = valid if valid is not None else F.lit(True)
    out = df.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total_pixels"), F.count_if(ok).alias("valid_pixels"), F.count_if(F.col(changed) & ok).alias("changed_pixels")
    )
    area = F.col("changed_pixels") * resolution * resolution
    share = F.when(F.col("valid_pixels") > 0, 100 * F.col("changed_pixels") / F.col("valid_pixels")).otherwise(0.0)
    return out.withColumns({"change_pct": share, "changed_sqm": area, "changed_hectares": area / 10_000})


def normalise_bands(px: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("site_id", "phase")) -> DataFrame:
    """Min-max scaling per site and band; flat or missing values become 0."""
    keys = list(keys)
    lim = px.groupBy(*keys).agg(*[f(b).alias(f"_{n}_{b}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))])
    out = px.join(lim, keys)
    scaled = {
        b: F.when(F.col(f"_hi_{b}") > F.col(f"_lo_{b}"), F.coalesce((F.col(b) - F.col(f"_lo_{b}")) / (F.col(f"_hi_{b}") - F.col(f"_lo_{b}")), F.lit(0.0))).otherwise(0.0)
        for b in bands
    }
    return out.withColumns(scaled).select(*px.columns)


def display_stretch(px: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("site_id", "phase")) -> DataFrame:
    """Linear stretch between the 2nd and 98th percentile to 0..255 per band."""
    keys = list(keys)
    out = px
    for b in bands:
        q = quantiles(px, keys, b, {"_p2": 0.02, "_p98": 0.98})
        v = F.least(F.greatest(F.col(b), F.col("_p2")), F.col("_p98"))
        level = F.when(F.col("_p98") <= F.col("_p2"), 0).otherwise(
            F.floor((v - F.col("_p2")) / F.when(F.col("_p98") > F.col("_p2"), F.col("_p98") - F.col("_p2")).otherwise(1.0) * 255)
        )
        out = out.join(q, keys).withColumn(b, level.cast("int")).drop("_p2", "_p98")
    return out.select(*px.columns)


def band_signature(px: DataFrame, mask: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Mean of each band inside a mask, per site and phase."""
    inside = px.join(mask.select(*PIXEL_KEY), list(PIXEL_KEY), "left_semi")
    return inside.groupBy("site_id", "phase").agg(*[F.avg(b).alias(b) for b in bands])


# -- thresholds --------------------------------------------------------------------

def otsu(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """Threshold per key that best splits a histogram of ``bins`` equal classes."""
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    lim = known.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    lim = lim.withColumn("_a", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))).withColumn(
        "_w", F.when(flat, 1.0).otherwise(F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")
    place = F.least(F.floor((F.col("_v") - F.col("_a")) / F.col("_w") * bins), F.lit(bins - 1)).cast("int")
    hist = known.join(lim, keys).withColumn("_b", place).groupBy(*keys, "_a", "_w", "_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most ``bins`` rows per key from here on
    upto = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    centre = F.col("_a") + (F.col("_b") + 0.5) * F.col("_w") / bins
    run = (
        hist.withColumn("_c", centre)
        .withColumn("_wb", F.sum("_n").over(upto)).withColumn("_sb", F.sum(F.col("_n") * F.col("_c")).over(upto))
        .withColumn("_t", F.sum("_n").over(whole)).withColumn("_st", F.sum(F.col("_n") * F.col("_c")).over(whole))
    )
    wf = F.col("_t") - F.col("_wb")
    gap = F.col("_sb") / F.col("_wb") - (F.col("_st") - F.col("_sb")) / F.when(wf > 0, wf)
    var = F.col("_wb").cast("double") * wf * gap * gap
    first = F.min(F.col("_a") + 0.5 * F.col("_w") / bins)
    best = F.max_by("_c", F.when(var > 0, F.struct(var, -F.col("_b"))))
    return run.groupBy(*keys).agg(F.coalesce(best, first).alias("threshold"))


def earthwork_mask(px: DataFrame, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(raw mask, change table): greenness fell below, or soil rose above, its own threshold."""
    ch = changes(indices(px, "epsilon"), ("ndvi", "bsi")).withColumn("_fall", -F.col("d_ndvi"))
    t1 = otsu(ch, ["site_id"], "_fall").withColumnRenamed("threshold", "_t1")
    t2 = otsu(ch, ["site_id"], "bsi_after").withColumnRenamed("threshold", "_t2")
    both = ch.join(t1, "site_id").join(t2, "site_id")
    hit = F.coalesce((F.col("d_ndvi") < -F.col("_t1")) | (F.col("bsi_after") > F.col("_t2")), F.lit(False))
    mask = both.filter(hit).select(*PIXEL_KEY, F.lit(height).alias("height"), F.lit(width).alias("width"))
    return mask, ch


def mean_change(mask: DataFrame, ch: DataFrame, value: str = "d_ndvi") -> DataFrame:
    return ch.join(mask.select(*PIXEL_KEY), list(PIXEL_KEY), "left_semi").groupBy("site_id").agg(F.avg(value).alias("mean_change"))


# -- neighbourhoods on tiles ----------------------------------------------------------

def _tiled(mask: DataFrame, margin: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``fn`` once per tile on its pixels and those within ``margin`` of it.

    A pixel is sent to at most four tiles; ``_tr, _tc`` name the tile.
    """
    if margin > TILE:
        raise ValueError("margin larger than a tile")

    def reach(c: str) -> Column:
        lo, hi = F.floor((F.col(c) - margin) / TILE), F.floor((F.col(c) + margin) / TILE)
        return F.sequence(F.greatest(lo, F.lit(0)).cast("int"), hi.cast("int"))

    spread = mask.withColumn("_tr", F.explode(reach("row"))).withColumn("_tc", F.explode(reach("col")))
    return spread.groupBy("site_id", "_tr", "_tc").applyInPandas(fn, schema)


def _window(pdf: pd.DataFrame, margin: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(set pixels, pixels inside the grid) of a tile with margin, and its origin."""
    r0 = int(pdf["_tr"].iat[0]) * TILE - margin
    c0 = int(pdf["_tc"].iat[0]) * TILE - margin
    n = TILE + 2 * margin
    grid = np.zeros((n, n), bool)
    grid[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = True
    rr, cc = np.arange(r0, r0 + n), np.arange(c0, c0 + n)
    inside = np.outer((rr >= 0) & (rr < pdf["height"].iat[0]), (cc >= 0) & (cc < pdf["width"].iat[0]))
    return grid, inside, r0, c0


def _shifts(shape: str, radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    if shape == "square":
        return [(i, j) for i in span for j in span]
    if shape == "disk":
        return [(i, j) for i in span for j in span if i * i + j * j <= radius * radius]
    raise ValueError(shape)


def _moved(a: np.ndarray, i: int, j: int, fill: bool) -> np.ndarray:
    out = np.full_like(a, fill)
    n, m = a.shape
    out[max(0, -i):n - max(0, i), max(0, -j):m - max(0, j)] = a[max(0, i):n - max(0, -i), max(0, j):m - max(0, -j)]
    return out


def _dilate(a: np.ndarray, inside: np.ndarray, shifts: Sequence[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(a)
    for i, j in shifts:
        out |= _moved(a, i, j, False)
    return out & inside


def _erode(a: np.ndarray, inside: np.ndarray, shifts: Sequence[tuple[int, int]], outside: bool) -> np.ndarray:
    base = a | ~inside if outside else a & inside
    out = inside.copy()
    for i, j in shifts:
        out &= _moved(base, i, j, outside)
    return out


_MASK_SCHEMA = "site_id {t}, row int, col int, height int, width int"


def _site_type(mask: DataFrame) -> str:
    return mask.schema["site_id"].dataType.simpleString()


def _tile_rows(pdf: pd.DataFrame, kept: np.ndarray, r0: int, c0: int, margin: int) -> pd.DataFrame:
    core = kept[margin:margin + TILE, margin:margin + TILE]
    r, c = np.nonzero(core)
    return pd.DataFrame({
        "site_id": pdf["site_id"].iat[0], "row": (r + r0 + margin).astype("int32"), "col": (c + c0 + margin).astype("int32"),
        "height": np.int32(pdf["height"].iat[0]), "width": np.int32(pdf["width"].iat[0]),
    })


def open_close(mask: DataFrame, shape: str = "square", open_radius: int = 1, close_radius: int = 1, border: bool = False) -> DataFrame:
    """Opening then closing in one shuffle. ``border``: outside counts as set when eroding."""
    margin = 2 * (open_radius + close_radius)
    first, second = _shifts(shape, open_radius), _shifts(shape, close_radius)

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, inside, r0, c0 = _window(pdf, margin)
        opened = _dilate(_erode(grid, inside, first, border), inside, first)
        closed = _erode(_dilate(opened, inside, second), inside, second, border)
        return _tile_rows(pdf, closed, r0, c0, margin)

    return _tiled(mask, margin, clean, _MASK_SCHEMA.format(t=_site_type(mask)))


def skeleton(mask: DataFrame, rounds_per_pass: int = 15) -> DataFrame:
    """Union of opening residues of successive erosions (3x3).

    Each pass peels several layers per tile; passes go on while pixels remain, up
    to half the smaller side of the grid.
    """
    margin = rounds_per_pass + 1
    box = _shifts("square", 1)
    schema = _MASK_SCHEMA.format(t=_site_type(mask)) + ", part string, depth int"

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, inside, r0, c0 = _window(pdf, margin)
        done = int(pdf["depth"].iat[0])
        limit = min(int(pdf["height"].iat[0]), int(pdf["width"].iat[0])) // 2
        bones = np.zeros_like(grid)
        for _ in range(min(rounds_per_pass, limit - done)):
            less = _erode(grid, inside, box, False)
            bones |= grid & ~_dilate(less, inside, box)
            grid = less
            done += 1
        left = grid if done < limit else np.zeros_like(grid)
        out = [_tile_rows(pdf, bones, r0, c0, margin).assign(part="bone"), _tile_rows(pdf, left, r0, c0, margin).assign(part="left")]
        return pd.concat(out).assign(depth=np.int32(done))

    rest, bones = mask.withColumn("depth", F.lit(0)), None
    while True:
        peeled = durable(_tiled(rest, margin, peel, schema))
        got = peeled.filter("part = 'bone'").select(*mask.columns)
        bones = got if bones is None else bones.unionByName(got)
        rest = peeled.filter("part = 'left'").select(*mask.columns, "depth")
        if rest.isEmpty():
            return bones.distinct()


# -- components ------------------------------------------------------------------------

def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Label the pixels of one tile by the smallest position of their 4-neighbour component."""
    r0, c0 = int(pdf["_tr"].iat[0]) * TILE, int(pdf["_tc"].iat[0]) * TILE
    where = np.full((TILE, TILE), -1, np.int64)
    r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    order = np.lexsort((c, r))
    r, c = r[order], c[order]
    where[r - r0, c - c0] = np.arange(len(r))
    parent = list(range(len(r)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(r)):
        y, x = r[i] - r0, c[i] - c0
        for n in ((where[y - 1, x] if y else -1), (where[y, x - 1] if x else -1)):
            if n >= 0:
                a, b = root(int(n)), root(i)
                parent[max(a, b)] = min(a, b)
    tops = np.array([root(i) for i in range(len(r))], np.int64)
    out = pdf.iloc[order][["site_id", "row", "col", "height", "width"]].copy()
    out["label"] = r[tops].astype("int64") * (1 << 31) + c[tops].astype("int64")
    return out


def components(mask: DataFrame, at_least: int = 1) -> DataFrame:
    """4-neighbour components; ``label`` is row * 2^31 + col of the first pixel.

    Tiles are labelled on their own; labels that touch across a tile border are
    then merged by the graph operator, on label pairs only.
    """
    from .graph import connected_components

    schema = _MASK_SCHEMA.format(t=_site_type(mask)) + ", label long"
    local = durable(_tiled(mask, 0, _label_tile, schema))
    here = local.select("site_id", "row", "col", F.col("label").alias("a"))

    def touching(axis: str) -> DataFrame:
        # last line of a tile against the first line of the next one
        edge = here.filter(F.col(axis) % TILE == TILE - 1).withColumn(axis, F.col(axis) + 1)
        return edge.join(here.withColumnRenamed("a", "b"), list(PIXEL_KEY))

    links = durable(touching("row").unionByName(touching("col")).select("site_id", "a", "b").distinct())
    out = local
    if not links.isEmpty():
        merged = connected_components(links, ["site_id"]).select("site_id", F.col("v").alias("label"), F.col("component"))
        out = local.join(merged, ["site_id", "label"], "left").withColumn("label", F.coalesce("component", "label")).select(*local.columns)
    if at_least > 1:
        big = out.groupBy("site_id", "label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
        out = out.join(big.select("site_id", "label"), ["site_id", "label"], "left_semi").select(*local.columns)
    return out


def component_metrics(labelled: DataFrame, resolution: float = 10.0) -> DataFrame:
    """Size, centroid, box, aspect, boundary pixels and compactness per component."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])
    key = ["site_id", "label"]
    # a pixel reached from itself and all four neighbours is interior
    reach = labelled.select(*key, "row", "col", F.inline(steps)).select(
        *key, (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col"),
        ((F.col("i") == 0) & (F.col("j") == 0)).alias("_own"),
    )
    cover = reach.groupBy(*key, "row", "col").agg(F.count(F.lit(1)).alias("_k"), F.bool_or("_own").alias("_own")).filter("_own")
    out = cover.groupBy(*key).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("_k") < 5).alias("boundary"),
        F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"),
        F.min("row").alias("top"), F.min("col").alias("left"),
        (F.max("row") - F.min("row") + 1).alias("box_height"), (F.max("col") - F.min("col") + 1).alias("box_width"),
    )
    long, short = F.greatest("box_height", "box_width"), F.least("box_height", "box_width")
    compact = F.least(4 * math.pi * F.col("pixels") / F.pow("boundary", F.lit(2)), F.lit(1.0))
    return out.withColumns({
        "area_sqm": F.col("pixels") * resolution * resolution, "perimeter_m": F.col("boundary") * resolution,
        "aspect": long / short, "compactness": compact,
    })


def water_bodies(px: DataFrame, height: int, width: int, threshold: float = 0.0, min_area: float = 100.0, resolution: float = 10.0) -> DataFrame:
    """Water patches of a minimum size; ``px`` has an ``ndwi`` column, one phase."""
    mask = px.filter(F.col("ndwi") > threshold).select(*PIXEL_KEY, F.lit(height).alias("height"), F.lit(width).alias("width"))
    clean = components(open_close(mask, "disk", 1, 2, border=True), at_least=5)
    return component_metrics(clean, resolution).filter(F.col("area_sqm") >= max(resolution**2, min_area))


def levelled_patches(ch: DataFrame, height: int, width: int, threshold: float = 0.10, min_area: float = 500.0, max_aspect: float = 6.0, resolution: float = 10.0) -> DataFrame:
    """Patches whose bare-soil index rose; elongated ones are left out."""
    mask = ch.filter(F.col("d_bsi") > threshold).select(*PIXEL_KEY, F.lit(height).alias("height"), F.lit(width).alias("width"))
    lab = components(open_close(mask, "disk", 2, 3, border=True), at_least=5)
    rise = lab.join(ch.select(*PIXEL_KEY, "d_bsi"), list(PIXEL_KEY)).groupBy("site_id", "label").agg(F.avg("d_bsi").alias("mean_bsi_change"))
    m = component_metrics(lab, resolution).filter((F.col("area_sqm") >= min_area) & (F.col("aspect") <= max_aspect))
    return m.join(rise, ["site_id", "label"])


# -- measurements and verdicts ----------------------------------------------------------

def line_measures(mask: DataFrame, resolution: float = 10.0, factor: float = 1.0) -> DataFrame:
    """Length, mean width and coherence of a road or canal from its skeleton."""
    bones = skeleton(mask).groupBy("site_id").agg(F.count(F.lit(1)).alias("skeleton_pixels"))
    total = mask.groupBy("site_id").agg(F.count(F.lit(1)).alias("mask_pixels"))
    out = total.join(bones, "site_id", "left").withColumn("skeleton_pixels", F.coalesce("skeleton_pixels", F.lit(0)))
    length = F.col("skeleton_pixels") * resolution * factor
    area = F.col("mask_pixels") * resolution * resolution
    return out.withColumns({
        "length_m": length, "width_m": F.when(length > 0, area / F.when(length > 0, length).otherwise(1.0)).otherwise(0.0), "area_sqm": area,
        "length_confidence": F.least(F.col("skeleton_pixels") / F.sqrt("mask_pixels") / 5, F.lit(1.0)),
        "width_confidence": F.least(F.greatest("skeleton_pixels", F.lit(1)) / 50, F.lit(1.0)),
    })


def pond_area(mask: DataFrame, resolution: float = 10.0) -> DataFrame:
    """Area and confidence of the largest component per site."""
    m = component_metrics(components(mask), resolution)
    best = F.max_by(F.struct("pixels", "area_sqm", "compactness"), F.struct(F.col("pixels"), -F.col("label")))
    out = m.groupBy("site_id").agg(best.alias("_b")).select("site_id", "_b.*")
    return out.withColumn("confidence", 0.6 * F.col("compactness") + 0.4 * F.least(F.col("pixels") / 100, F.lit(1.0)))


def levelling_area(mask: DataFrame, resolution: float = 10.0) -> DataFrame:
    out = mask.groupBy("site_id").agg(F.count(F.lit(1)).alias("pixels"))
    return out.withColumns({
        "area_sqm": F.col("pixels") * resolution * resolution, "confidence": F.least(F.col("pixels") / 200, F.lit(1.0))
    })


def with_deviation(measures: DataFrame) -> DataFrame:
    """Percent deviation of ``estimated`` from a positive ``reported``."""
    r = F.col("reported")
    return measures.withColumn("deviation_pct", F.when(r > 0, F.abs(F.col("estimated") - r) / F.when(r > 0, r).otherwise(1.0) * 100).otherwise(0.0))


def work_verdict(measures: DataFrame, work: str = "work_id", tolerance_pct: float = 20.0) -> DataFrame:
    """Status per work from its measures (``estimated, reported, confidence``)."""
    m = with_deviation(measures)
    agg = m.groupBy(work).agg(
        F.avg("confidence").alias("confidence"), F.max("estimated").alias("_most"),
        F.avg(F.when(F.col("reported") > 0, F.col("deviation_pct"))).alias("mean_deviation_pct"),
    )
    dev = F.col("mean_deviation_pct")
    status = (
        F.when(~F.coalesce(F.col("_most") > 0, F.lit(False)), "not_detected").when(dev.isNull(), "partial_match")
        .when(dev <= tolerance_pct, "verified").when(dev <= 2 * tolerance_pct, "partial_match").otherwise("mismatch")
    )
    return agg.withColumn("verification_status", status).drop("_most")


def comparison_rows(measures: DataFrame, work: str = "work_id", tolerance_pct: float = 20.0) -> DataFrame:
    """One row per work and dimension with its deviation and the verdict of the work."""
    rows = with_deviation(measures).select(work, "dimension", "estimated", "reported", "deviation_pct")
    return rows.join(work_verdict(measures, work, tolerance_pct), work)


def satellite_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of mismatching or weak results plus half the share of nothing found."""
    n = F.count(F.lit(1))
    weak = F.count_if((F.col("verification_status") == "mismatch") | (F.coalesce("confidence_score", F.lit(1.0)) < 0.5))
    none = F.count_if(F.col("verification_status") == "not_detected")
    return df.groupBy(*keys).agg(F.least(weak / n + 0.5 * none / n, F.lit(1.0)).alias("satellite_score"))
