"""Grid arithmetic and polygon measures over ``ARRAY<ARRAY<STRUCT<x,y>>>`` rings, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltacell.functions import crs


# -- grids -----------------------------------------------------------------------------------

def cell_center(row: Column, col: Column, gt: list[float]) -> tuple[Column, Column]:
    c, r = col + 0.5, row + 0.5
    return gt[0] + c * gt[1] + r * gt[2], gt[3] + c * gt[4] + r * gt[5]


def point_to_cell(x: Column, y: Column, gt: list[float]) -> tuple[Column, Column]:
    """Row and column whose cell holds the point."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    dx, dy = x - gt[0], y - gt[3]
    col = F.floor((gt[5] * dx - gt[2] * dy) / det)
    row = F.floor((gt[1] * dy - gt[4] * dx) / det)
    return row.cast("int"), col.cast("int")


def same_grid(a: Column, b: Column, tol: float = 1e-9) -> Column:
    """Size, CRS and affine agree; ``a`` and ``b`` are grid structs."""
    affine = F.forall(F.zip_with(a["gt"], b["gt"], lambda p, q: F.abs(p - q) <= tol), lambda ok: ok)
    return (a["width"] == b["width"]) & (a["height"] == b["height"]) & (a["epsg"] == b["epsg"]) & affine


def aligned(a: Column, b: Column, tol: float = 1e-6) -> Column:
    """Same cell size and CRS, and origins a whole number of cells apart."""
    def whole(offset: Column) -> Column:
        return F.abs(offset - F.round(offset)) <= tol

    size = (F.abs(a["gt"][1] - b["gt"][1]) <= tol) & (F.abs(a["gt"][5] - b["gt"][5]) <= tol)
    return (
        (a["epsg"] == b["epsg"])
        & size
        & whole((b["gt"][0] - a["gt"][0]) / a["gt"][1])
        & whole((b["gt"][3] - a["gt"][3]) / a["gt"][5])
    )


def cell_area_m2(gt: Column, epsg: Column) -> Column:
    """Ground area of one cell; geographic grids use the latitude half a cell below the top."""
    planar = F.abs(gt[1] * gt[5] - gt[2] * gt[4])
    # The latitude is kept within 89.5 degrees; series for the metres of a degree of latitude.
    lat = F.radians(F.greatest(F.lit(-89.5), F.least(F.lit(89.5), gt[3] + gt[5] * 0.5)))
    per_lat = 111132.954 - 559.822 * F.cos(2 * lat) + 1.175 * F.cos(4 * lat)
    per_lon = F.lit(math.pi / 180 * crs.A) * F.cos(lat)
    return F.when(epsg == 4326, F.abs(gt[1]) * per_lon * F.abs(gt[5]) * per_lat).otherwise(planar)


def equal_area_cell_m2(row: Column, col: Column, gt: list[float], epsg: int) -> Column:
    """Area of a cell's four corners after conversion to the equal-area projection."""
    corners = []
    for dr, dc in ((0, 0), (0, 1), (1, 1), (1, 0)):
        r, c = row + dr, col + dc
        x, y = gt[0] + c * gt[1] + r * gt[2], gt[3] + c * gt[4] + r * gt[5]
        corners.append(crs.reproject(x, y, epsg, 6933))
    area = F.lit(0.0)  # by trapezoids, as products of whole coordinates would cost the last digits
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        area = area + (x2 - x1) * (y1 + y2) / 2
    return F.abs(area)


def window_bounds(bbox: list[float], gt: list[float], width: int, height: int) -> tuple[int, int, int, int] | None:
    """Row and column range (inclusive) of a bbox clamped to the grid; ``None`` when they miss."""
    xmin, ymin, xmax, ymax = bbox
    c0, c1 = math.floor((xmin - gt[0]) / gt[1]), math.ceil((xmax - gt[0]) / gt[1])
    r0, r1 = math.floor((ymax - gt[3]) / gt[5]), math.ceil((ymin - gt[3]) / gt[5])
    c0, r0, c1, r1 = max(c0, 0), max(r0, 0), min(c1, width), min(r1, height)
    return None if c0 >= c1 or r0 >= r1 else (r0, r1 - 1, c0, c1 - 1)


def snap_bounds(xmin: Column, ymin: Column, xmax: Column, ymax: Column, step: float = 10.0, pad: float = 0.0) -> Column:
    """Envelope grown to whole steps: struct of bounds, width and height in cells."""
    lo = lambda v: F.floor((v - pad) / step) * step
    hi = lambda v: (F.floor((v + pad) / step) + 1) * step
    return F.struct(
        lo(xmin).alias("xmin"), lo(ymin).alias("ymin"), hi(xmax).alias("xmax"), hi(ymax).alias("ymax"),
        F.round((hi(xmax) - lo(xmin)) / step).cast("int").alias("width"),
        F.round((hi(ymax) - lo(ymin)) / step).cast("int").alias("height"),
    )


def grid_bbox_lonlat(grids: DataFrame, epsg: int) -> DataFrame:
    """WGS84 bounding box of each grid from a 3 x 3 set of sample points."""
    fractions = F.array(*[F.lit(v) for v in (0.0, 0.5, 1.0)])
    points = grids.withColumn("_fy", F.explode(fractions)).withColumn("_fx", F.explode(fractions))
    gt = F.col("gt")
    w, h = F.col("width") * F.col("_fx"), F.col("height") * F.col("_fy")
    lon, lat = crs.to_lonlat(gt[0] + gt[1] * w + gt[2] * h, gt[3] + gt[4] * w + gt[5] * h, epsg)
    return points.select("grid_id", lon.alias("_lon"), lat.alias("_lat")).groupBy("grid_id").agg(
        F.min("_lon").alias("xmin"), F.min("_lat").alias("ymin"),
        F.max("_lon").alias("xmax"), F.max("_lat").alias("ymax"),
    )


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of a 10 degree tile from its upper-left corner, such as ``50N_030E``."""
    return F.concat(
        F.lpad(F.abs(lat).cast("int").cast("string"), 2, "0"), F.when(lat >= 0, "N").otherwise("S"), F.lit("_"),
        F.lpad(F.abs(lon).cast("int").cast("string"), 3, "0"), F.when(lon >= 0, "E").otherwise("W"),
    )


def tiles_for_bbox(df: DataFrame, degrees: int = 10, lat_range: tuple[float, float] = (-60.0, 80.0)) -> DataFrame:
    """One row per (input row, tile), tiles numbered north to south then west to east.

    Input columns ``xmin ymin xmax ymax``. A bbox outside the covered latitudes, or with its
    bounds the wrong way round, is an error.
    """
    d = F.lit(degrees)
    ok = (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))
    covered = (F.col("ymin") >= lat_range[0]) & (F.col("ymax") <= lat_range[1])
    guard = F.when(ok & covered, F.col("ymax")).otherwise(F.raise_error(F.lit("invalid bbox or latitude")).cast("double"))
    top = F.ceil(guard / d) * d
    bottom = F.floor(F.col("ymin") / d) * d + d
    left = F.floor(F.col("xmin") / d) * d
    right = F.ceil(F.col("xmax") / d) * d - d
    return (
        df.withColumn("_lat", F.explode(F.sequence(top.cast("int"), bottom.cast("int"), F.lit(-degrees))))
        .withColumn("_lon", F.explode(F.sequence(left.cast("int"), right.cast("int"), F.lit(degrees))))
        .withColumn("tile", tile_name(F.col("_lat"), F.col("_lon")))
        .withColumn("tile_row", ((top - F.col("_lat")) / d).cast("int"))
        .withColumn("tile_col", ((F.col("_lon") - left) / d).cast("int"))
        .drop("_lat", "_lon")
    )


# -- rings -----------------------------------------------------------------------------------

def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _following(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def edges(ring: Column) -> Column:
    """Array of struct(x1, y1, x2, y2); the ring may or may not repeat its first point."""
    side = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return bind(ring, lambda r: F.zip_with(r, _following(r), side))


def ring_signed_area(ring: Column) -> Column:
    return F.aggregate(
        edges(ring), F.lit(0.0), lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"])
    ) / 2


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring, by the sides that a line to its right crosses."""
    def crossed(e: Column) -> Column:
        level = (e["y1"] <= y) != (e["y2"] <= y)
        return (level & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))).cast("int")

    return F.aggregate(edges(ring), F.lit(0), lambda n, e: n + F.coalesce(crossed(e), F.lit(0))) % 2 == 1


def nested_polygons(rings: Column) -> Column:
    """Rings as polygons, each an outer ring followed by its holes; a ring within a hole is a polygon again."""
    within = lambda r, s: in_ring(r[0]["x"], r[0]["y"], s) & (r != s)
    deep = F.transform(rings, lambda r: F.struct(r.alias("ring"), F.size(F.filter(rings, lambda s: within(r, s))).alias("depth")))

    def polygon(all_rings: Column, o: Column) -> Column:
        holes = F.filter(all_rings, lambda h: (h["depth"] == o["depth"] + 1) & within(h["ring"], o["ring"]))
        return F.concat(F.array(o["ring"]), F.transform(holes, lambda h: h["ring"]))

    return bind(deep, lambda d: F.transform(F.filter(d, lambda o: o["depth"] % 2 == 0), lambda o: polygon(d, o)))


def rings_area(rings: Column) -> Column:
    """Planar area of an outer ring followed by its holes, or of several outer rings alike wound."""
    return F.abs(F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + ring_signed_area(r)))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""
    crossings = F.filter(
        edges(ring),
        lambda e: ((e["y1"] <= y) != (e["y2"] <= y))
        & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))),
    )
    return F.size(crossings) % 2 == 1


def rings_bbox(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )


def n_vertices(rings: Column) -> Column:
    return F.size(F.flatten(rings))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax))


def share_inside(df: DataFrame, keys: list[str], n: int = 12, ring: str = "ring") -> DataFrame:
    """Share of an n x n set of points of each row's bbox that fall inside its ring."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    points = df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    x = F.col("xmin") + (F.col("_i") + 0.5) * (F.col("xmax") - F.col("xmin")) / n
    y = F.col("ymin") + (F.col("_j") + 0.5) * (F.col("ymax") - F.col("ymin")) / n
    return points.groupBy(*keys).agg(F.avg(in_ring(x, y, F.col(ring)).cast("double")).alias("share"))


def parse_ring(text: Column) -> Column:
    """Flat ``"a1 b1 a2 b2 ..."`` string as a struct of its two readings, (a, b) and (b, a).

    A reading whose longitudes or latitudes leave their range is NULL, as is a string with fewer
    than three points.
    """
    texts = F.split(F.trim(F.regexp_replace(text, "[,\\s]+", " ")), " ")

    def reading(numbers: Column, first: int, second: int) -> Column:
        at = F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1)
        points = F.transform(
            at,
            lambda i: F.struct(
                F.get(numbers, 2 * i + first).alias("x"), F.get(numbers, 2 * i + second).alias("y")
            ),
        )
        fine = lambda r: F.forall(r, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
        return F.when(F.size(numbers) >= 6, bind(points, lambda r: F.when(fine(r), r)))

    return bind(
        F.transform(texts, lambda s: s.try_cast("double")),
        lambda n: F.struct(reading(n, 0, 1).alias("as_given"), reading(n, 1, 0).alias("swapped")),
    )


# -- convex clipping --------------------------------------------------------------------------

def _clip_half_plane(points: Column, inside, cross) -> Column:
    def step(p: Column, q: Column, none: Column) -> Column:
        kept = F.when(inside(q), F.array(q)).otherwise(none)
        return F.when(inside(p) == inside(q), kept).otherwise(F.concat(F.array(cross(p, q)), kept))

    return bind(
        points, lambda r: F.flatten(F.zip_with(r, _following(r), lambda p, q: step(p, q, F.slice(r, 1, 0))))
    )


def clip_to_box(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Ring cut to an axis-parallel box, one half-plane at a time."""
    def at_x(v: Column):
        return lambda p, q: F.struct(
            v.cast("double").alias("x"), (p["y"] + (v - p["x"]) * (q["y"] - p["y"]) / (q["x"] - p["x"])).alias("y")
        )

    def at_y(v: Column):
        return lambda p, q: F.struct(
            (p["x"] + (v - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])).alias("x"), v.cast("double").alias("y")
        )

    out = _clip_half_plane(ring, lambda p: p["x"] >= xmin, at_x(xmin))
    out = _clip_half_plane(out, lambda p: p["x"] <= xmax, at_x(xmax))
    out = _clip_half_plane(out, lambda p: p["y"] >= ymin, at_y(ymin))
    return _clip_half_plane(out, lambda p: p["y"] <= ymax, at_y(ymax))


def clip_to_convex(ring: Column, hull: Column) -> Column:
    """Ring cut to a convex ring wound counter-clockwise, one of its sides at a time."""
    def beyond(e: Column, p: Column) -> Column:
        return (e["x2"] - e["x1"]) * (p["y"] - e["y1"]) - (e["y2"] - e["y1"]) * (p["x"] - e["x1"])

    def cross(e: Column):
        def at(p: Column, q: Column) -> Column:
            t = beyond(e, p) / (beyond(e, p) - beyond(e, q))
            return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))

        return at

    shape = "array<struct<x:double,y:double>>"
    return F.aggregate(
        edges(hull), ring.cast(shape), lambda r, e: _clip_half_plane(r, lambda p: beyond(e, p) >= 0, cross(e)).cast(shape)
    )


def hull_coverage(ring: Column, hull: Column) -> Column:
    """Share of a convex ring (counter-clockwise) covered by a ring of any shape."""
    return F.try_divide(F.abs(ring_signed_area(clip_to_convex(ring, hull))), F.nullif(F.abs(ring_signed_area(hull)), F.lit(0.0)))


def box_coverage(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Share of a box covered by a ring."""
    clipped = clip_to_box(ring, xmin, ymin, xmax, ymax)
    return F.try_divide(F.abs(ring_signed_area(clipped)), F.nullif((xmax - xmin) * (ymax - ymin), F.lit(0.0)))


def pick_ring_reading(readings: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Of the two axis orders, the one that overlaps the query box more; ties keep the given order."""
    given, swapped = readings["as_given"], readings["swapped"]
    better = F.coalesce(box_coverage(swapped, xmin, ymin, xmax, ymax), F.lit(-1.0)) > F.coalesce(
        box_coverage(given, xmin, ymin, xmax, ymax), F.lit(-1.0)
    )
    return F.when(better, swapped).otherwise(given)
