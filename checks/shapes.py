"""Objects, resampling, polygons and coordinates."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query, r6
from deltacell import schema as S
from deltacell.functions import crs
from deltacell.functions import geometry as G
from deltacell.functions.hull import convex_hull
from deltacell.operators import align, cover, evaluate, objects, resample
from deltacell.session import scratch_root, settle
from deltacell.sources import catalogs, sinks, tables

CELL = ["grid_id", "row", "col"]
TILE = 64

# -- objects -------------------------------------------------------------------------------------

_LABELS = """
, m AS (SELECT grid_id, "row", col FROM raw_field WHERE value > {limit}),
near AS (SELECT a.grid_id, a."row" AS r1, a.col AS c1, b."row" AS r2, b.col AS c2 FROM m a JOIN m b
  ON a.grid_id = b.grid_id AND b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1),
reach AS (SELECT grid_id, "row" AS r0, col AS c0, "row", col FROM m
  UNION SELECT reach.grid_id, r0, c0, r2, c2 FROM reach JOIN near ON near.grid_id = reach.grid_id AND near.r1 = reach."row" AND near.c1 = reach.col),
lab AS (SELECT grid_id, r0 AS "row", c0 AS col, min("row" * 2147483648 + col) AS label FROM reach GROUP BY ALL)"""


def _labelled(spark, sf, limit=0.15):
    return objects.components(V.raw_field(spark, sf).where(F.col("value") > limit), TILE)


@query("components", _LABELS.format(limit=0.15) + 'SELECT grid_id, "row", col, label FROM lab', "raw_field")
def components(spark, sf):
    return _labelled(spark, sf).select(*CELL, "label")


@query("min_size", _LABELS.format(limit=0.15) + """
SELECT grid_id, "row", col FROM lab JOIN (SELECT grid_id, label FROM lab GROUP BY ALL HAVING count(*) >= 4) USING (grid_id, label)""", "raw_field")
def min_size(spark, sf):
    return objects.remove_small(_labelled(spark, sf), 4).select(*CELL)


@query("objects", _LABELS.format(limit=0.15) + """
SELECT grid_id, label, count(*) AS n_px, round(count(*) * 100.0::DOUBLE / 1e4, 6) AS area_ha, min("row") AS row_min, max("row") AS row_max,
  min(col) AS col_min, max(col) AS col_max FROM lab GROUP BY grid_id, label""", "raw_field")
def object_table(spark, sf):
    return objects.object_stats(_labelled(spark, sf), 100.0).withColumn("area_ha", r6("area_ha"))


@query("object_outlines")
def object_outlines(spark, sf):
    return objects.outlines(settle(_labelled(spark, sf)), [500000.0, 10.0, 0.0, 5002500.0, 0.0, -10.0])


@query("outline_measures", _LABELS.format(limit=0.15) + """
, corner AS (SELECT grid_id, label, "row" + dr AS vr, col + dc AS vc, count(*) AS n, sum((1 - 2 * dr) * (1 - 2 * dc)) AS s
  FROM lab, range(2) a(dr), range(2) b(dc) GROUP BY ALL),
turns AS (SELECT grid_id, label, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND s <> 0 THEN 2 ELSE 0 END)::INT AS n_corners FROM corner GROUP BY ALL)
SELECT grid_id, label, n_corners, round(n * 100.0::DOUBLE, 4) AS area
FROM turns JOIN (SELECT grid_id, label, count(*) AS n FROM lab GROUP BY ALL) USING (grid_id, label)""", "raw_field")
def outline_measures(spark, sf):
    """Corners and area of every outline, read back from its text."""
    rings = F.transform(F.regexp_extract_all("wkt", F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda t: F.transform(
        F.split(t, ", "), lambda q: F.struct(F.split(q, " ")[0].cast("double").alias("x"), F.split(q, " ")[1].cast("double").alias("y"))))
    out = object_outlines(spark, sf).withColumn("rings", rings)
    corners = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r) - 1)
    return out.select("grid_id", "label", corners.alias("n_corners"), r6(G.rings_area(F.col("rings")), 4).alias("area"))


@query("ring_points", _LABELS.format(limit=0.15) + """
, corner AS (SELECT grid_id, label, "row" + dr AS vr, col + dc AS vc, count(*) AS n, sum((1 - 2 * dr) * (1 - 2 * dc)) AS s
  FROM lab, range(2) a(dr), range(2) b(dc) GROUP BY ALL),
turns AS (SELECT grid_id, label, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND s <> 0 THEN 2 ELSE 0 END)::INT AS n_corners FROM corner GROUP BY ALL)
SELECT grid_id, label, n_corners, n * 2 AS twice_area, 0 AS broken
FROM turns JOIN (SELECT grid_id, label, count(*) AS n FROM lab GROUP BY ALL) USING (grid_id, label)""", "raw_field")
def ring_points(spark, sf):
    """Corners and area of outlines whose order is found by joins; consecutive corners lie on one line."""
    points = settle(objects.ring_points(settle(_labelled(spark, sf))))
    w = Window.partitionBy("grid_id", "ring").orderBy("place")
    first = F.first(F.struct("r", "c")).over(w)
    after = F.coalesce(F.lead(F.struct("r", "c")).over(w), first)
    sides = points.withColumn("_a", after)
    cross = F.col("c") * F.col("_a.r") - F.col("_a.c") * F.col("r")
    askew = ((F.col("r") != F.col("_a.r")) & (F.col("c") != F.col("_a.c"))).cast("int")
    return sides.groupBy("grid_id", "label").agg(
        F.count(F.lit(1)).alias("n_corners"), F.abs(F.sum(cross)).alias("twice_area"), F.sum(askew).alias("broken")
    )


_TWO = _LABELS.format(limit=0.15) + """
, two AS (SELECT * FROM lab), det AS (SELECT grid_id, "row", col FROM raw_field WHERE value > 0.12 AND col % 4 <> 0),
dnear AS (SELECT a.grid_id, a."row" AS r1, a.col AS c1, b."row" AS r2, b.col AS c2 FROM det a JOIN det b
  ON a.grid_id = b.grid_id AND b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1),
dreach AS (SELECT grid_id, "row" AS r0, col AS c0, "row", col FROM det
  UNION SELECT dreach.grid_id, r0, c0, r2, c2 FROM dreach JOIN dnear ON dnear.grid_id = dreach.grid_id AND dnear.r1 = dreach."row" AND dnear.c1 = dreach.col),
dlab AS (SELECT grid_id, r0 AS "row", c0 AS col, min("row" * 2147483648 + col) AS label FROM dreach GROUP BY ALL),
rs AS (SELECT grid_id, label, count(*) AS n, count(det.col) AS hit FROM lab LEFT JOIN det USING (grid_id, "row", col) GROUP BY ALL),
ds AS (SELECT grid_id, d.label, count(*) AS n, count(l.label) AS hit FROM dlab d LEFT JOIN lab l USING (grid_id, "row", col) GROUP BY ALL)"""


def _detected(spark, sf):
    return V.raw_field(spark, sf).where((F.col("value") > 0.12) & (F.col("col") % 4 != 0))


@query("object_metrics", _TWO + """
, a AS (SELECT grid_id, count(*) AS n_ref, (count(*) FILTER (hit >= 0.3 * n)) AS tp_ref FROM rs GROUP BY grid_id),
b AS (SELECT grid_id, count(*) AS n_det, (count(*) FILTER (hit >= 0.3 * n)) AS tp_det FROM ds GROUP BY grid_id)
SELECT grid_id, n_ref, n_det, tp_ref, tp_det, round(tp_ref / n_ref, 4) AS pa, round(tp_det / n_det, 4) AS ua,
  round(2 * (tp_ref / n_ref) * (tp_det / n_det) / (tp_ref / n_ref + tp_det / n_det), 4) AS f1 FROM a JOIN b USING (grid_id)""", "raw_field")
def object_metrics(spark, sf):
    m = evaluate.object_metrics(settle(_labelled(spark, sf)), settle(objects.components(_detected(spark, sf), TILE)))
    return m.select("grid_id", "n_ref", "n_det", "tp_ref", "tp_det", *[r6(c, 4).alias(c) for c in ("pa", "ua", "f1")])


@query("overlap_counts", _TWO + "SELECT grid_id, label, n AS n_px, hit AS n_hit FROM rs", "raw_field")
def overlap_counts(spark, sf):
    return evaluate.component_overlap(_labelled(spark, sf), _detected(spark, sf))


@query("hit_rate_by_size", _TWO + """
SELECT grid_id, CASE WHEN n * 0.9 < 2 THEN '0-2 ha' WHEN n * 0.9 < 5 THEN '2-5 ha' WHEN n * 0.9 < 10 THEN '5-10 ha' ELSE '10-max ha' END AS size_class,
  count(*) AS n, round(avg(CASE WHEN hit >= 0.3 * n THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
FROM rs GROUP BY ALL""".replace("count(*) AS n,", "count(*) AS n_components,").replace("AS n_components,", "AS n_c,"), "raw_field")
def hit_rate_by_size(spark, sf):
    h = evaluate.hit_rate_by_size(_labelled(spark, sf), _detected(spark, sf), 0.9)
    return h.select("grid_id", "size_class", F.col("n").alias("n_c"), r6("hit_rate").alias("hit_rate"))


# -- resampling ------------------------------------------------------------------------------------

SOURCE = {"gt": [0.0, 10.0, 0.0, 2500.0, 0.0, -10.0], "epsg": 32633, "width": 64, "height": 250}
TARGET = {"gt": [3.0, 20.0, 0.0, 2496.0, 0.0, -20.0], "epsg": 32633, "width": 33, "height": 126}
_TARGET_SQL = """
, g AS (SELECT DISTINCT grid_id FROM field),
t AS (SELECT grid_id, CAST(a AS INTEGER) AS "row", CAST(b AS INTEGER) AS col, 3 + 20.0 * (b + 0.5)::DOUBLE AS x, 2496 - 20.0 * (a + 0.5)::DOUBLE AS y
  FROM g, range(126) p(a), range(33) q(b))"""


@query("resample_nearest", _TARGET_SQL + """
SELECT t.grid_id, t."row", t.col, round(f.value, 6) AS value FROM t LEFT JOIN field f ON f.grid_id = t.grid_id
  AND f."row" = floor((2500 - t.y) / 10)::INTEGER AND f.col = floor(t.x / 10)::INTEGER""", "raw_field field")
def resample_nearest(spark, sf):
    return resample.nearest(V.field(spark, sf), SOURCE, TARGET).withColumn("value", r6("value"))


@query("resample_bilinear", _TARGET_SQL + """
, q AS (SELECT *, x / 10 - 0.5 AS fc, (2500 - y) / 10 - 0.5 AS fr FROM t),
n AS (SELECT q.*, floor(fr) + dr AS sr, floor(fc) + dc AS sc,
  CASE WHEN dr = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE WHEN dc = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS w
  FROM q, range(2) a(dr), range(2) b(dc))
SELECT n.grid_id, n."row", n.col, round(sum(w * f.value) / nullif(sum(w) FILTER (f.value IS NOT NULL), 0), 5) AS value
FROM n LEFT JOIN field f ON f.grid_id = n.grid_id AND f."row" = n.sr AND f.col = n.sc WHERE w > 0 GROUP BY ALL""", "raw_field field")
def resample_bilinear(spark, sf):
    return resample.bilinear(V.field(spark, sf), SOURCE, TARGET).withColumn("value", r6("value", 5))


@query("resample_average", """
SELECT grid_id, CAST(floor((2496 - (2500 - ("row" * 10 + 5))) / 20.0) AS INTEGER) AS "row", CAST(floor((col * 10 + 5 - 3) / 20.0) AS INTEGER) AS col,
  round(avg(value), 6) AS value FROM field WHERE 2496 - (2500 - ("row" * 10 + 5)) >= 0 GROUP BY ALL""", "raw_field field")
def resample_average(spark, sf):
    return resample.average(V.field(spark, sf), SOURCE, TARGET).withColumn("value", r6("value"))


@query("fraction_mask", """
SELECT grid_id, CAST(floor((2496 - (2500 - ("row" * 10 + 5))) / 20.0) AS INTEGER) AS "row", CAST(floor((col * 10 + 5 - 3) / 20.0) AS INTEGER) AS col
FROM raw_field WHERE 2496 - (2500 - ("row" * 10 + 5)) >= 0 GROUP BY ALL HAVING avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) >= 0.5""", "raw_field")
def fraction_mask(spark, sf):
    cells = V.raw_field(spark, sf).withColumn("on", F.col("value") > 0)
    return resample.fraction_mask(cells, SOURCE, TARGET, "on")


@query("window_read", """
SELECT grid_id, "row", col, round(value, 6) AS value FROM field WHERE "row" BETWEEN 90 AND 150 AND col BETWEEN 10 AND 30""", "raw_field field")
def window_read(spark, sf):
    return resample.window(V.field(spark, sf), [104.0, 995.0, 301.0, 1600.0], SOURCE).withColumn("value", r6("value"))


@query("window_read_stored", """
SELECT grid_id, "row", col, round(value, 6) AS value FROM field WHERE "row" BETWEEN 90 AND 150 AND col BETWEEN 10 AND 30""", "raw_field field")
def window_read_stored(spark, sf):
    """Written by blocks of tiles and read back by a bbox, which leaves out the blocks it does not touch."""
    path = f"{scratch_root(spark)}/window-{uuid.uuid4().hex}"
    sinks.write_index(V.field(spark, sf), path, tile=16, block=2)
    cells = tables.read_window(spark, path, S.INDEX.replace("run_id STRING, ", ""), [104.0, 995.0, 301.0, 1600.0], SOURCE, tile=16, block=2)
    return cells.select("grid_id", "row", "col", r6("value").alias("value"))


# Grids that differ from row to row: even ones lie in zone 33, odd ones south of the equator in zone 34;
# targets are degrees and Mercator metres, of other cell sizes.
def _grid_rows(spark, sf, even: dict, odd: dict):
    ids = V.field(spark, sf).select("grid_id").distinct()
    pick = F.substring("grid_id", 2, 10).cast("int") % 2 == 0
    side = lambda n, kind: F.when(pick, F.lit(even[n])).otherwise(F.lit(odd[n])).cast(kind).alias(n)
    gt = F.when(pick, F.array(*map(F.lit, even["gt"]))).otherwise(F.array(*map(F.lit, odd["gt"]))).alias("gt")
    return ids.select("grid_id", side("width", "int"), side("height", "int"), gt, side("epsg", "int"), F.lit(None).cast("double").alias("nodata"))


_OWN_EVEN = {"gt": [500100.0, 10.0, 0.0, 5004000.0, 0.0, -10.0], "epsg": 32633, "width": 64, "height": 250}
_OWN_ODD = {"gt": [500100.0, 10.0, 0.0, 5004000.0, 0.0, -10.0], "epsg": 32734, "width": 64, "height": 250}
_TO_EVEN = {"gt": [15.0011, 0.00017, 0.0, 45.1895, 0.0, -0.00013], "epsg": 4326, "width": 50, "height": 150}
_TO_ODD = {"gt": [2337820.0, 23.0, 0.0, -5632100.0, 0.0, -23.0], "epsg": 3857, "width": 40, "height": 140}

_ALIGN_SQL = """
, g AS (SELECT DISTINCT grid_id, CAST(substr(grid_id, 2) AS INTEGER) % 2 AS odd FROM field),
te AS (SELECT grid_id, odd, CAST(a AS INTEGER) AS "row", CAST(b AS INTEGER) AS col, 15.0011::DOUBLE + 0.00017::DOUBLE * (b + 0.5::DOUBLE) AS lon,
  45.1895::DOUBLE - 0.00013::DOUBLE * (a + 0.5::DOUBLE) AS lat FROM g, range(150) p(a), range(50) q(b) WHERE odd = 0),
tm AS (SELECT grid_id, odd, CAST(a AS INTEGER) AS "row", CAST(b AS INTEGER) AS col, degrees((2337820.0::DOUBLE + 23 * (b + 0.5::DOUBLE)) / 6378137) AS lon,
  degrees(2 * atan(exp((-5632100.0::DOUBLE - 23 * (a + 0.5::DOUBLE)) / 6378137)) - pi() / 2) AS lat FROM g, range(140) p(a), range(40) q(b) WHERE odd = 1),
tl AS (SELECT * FROM te UNION ALL SELECT * FROM tm),
e0 AS (SELECT *, 1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE) AS n, sqrt(1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE)) AS e,
  radians(lat) AS p, radians(lon - CASE odd WHEN 0 THEN 15 ELSE 21 END) AS l FROM tl),
e1 AS (SELECT *, sinh(atanh(sin(p)) - e * atanh(e * sin(p))) AS t FROM e0),
e2 AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta, 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS big,
  n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 AS k1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 AS k2,
  61 * n ** 3 / 240 - 103 * n ** 4 / 140 AS k3, 49561 * n ** 4 / 161280 AS k4 FROM e1),
e3 AS (SELECT grid_id, odd, "row", col, 500000 + 0.9996::DOUBLE * big * (eta + k1 * cos(2 * xi) * sinh(2 * eta) + k2 * cos(4 * xi) * sinh(4 * eta)
    + k3 * cos(6 * xi) * sinh(6 * eta) + k4 * cos(8 * xi) * sinh(8 * eta)) AS x,
  CASE odd WHEN 0 THEN 0 ELSE 1e7 END + 0.9996::DOUBLE * big * (xi + k1 * sin(2 * xi) * cosh(2 * eta) + k2 * sin(4 * xi) * cosh(4 * eta)
    + k3 * sin(6 * xi) * cosh(6 * eta) + k4 * sin(8 * xi) * cosh(8 * eta)) AS y FROM e2),
t AS (SELECT grid_id, "row", col, (x - 500100) / 10 AS pc, (5004000 - y) / 10 AS pr FROM e3)"""


def _aligned(spark, sf, how):
    own, to = _grid_rows(spark, sf, _OWN_EVEN, _OWN_ODD), _grid_rows(spark, sf, _TO_EVEN, _TO_ODD)
    return align.align(V.field(spark, sf), own, to, how, tile=64)


@query("align_nearest", _ALIGN_SQL + """
SELECT t.grid_id, t."row", t.col, round(f.value, 6) AS value FROM t LEFT JOIN field f
  ON f.grid_id = t.grid_id AND f."row" = floor(pr)::INTEGER AND f.col = floor(pc)::INTEGER""", "raw_field field")
def align_nearest(spark, sf):
    return _aligned(spark, sf, "nearest").withColumn("value", r6("value"))


@query("align_bilinear", _ALIGN_SQL + """
, q AS (SELECT *, pr - 0.5::DOUBLE AS fr, pc - 0.5::DOUBLE AS fc FROM t),
n AS (SELECT q.*, floor(fr) + dr AS sr, floor(fc) + dc AS sc,
  CASE WHEN dr = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE WHEN dc = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS w
  FROM q, range(2) a(dr), range(2) b(dc))
SELECT n.grid_id, n."row", n.col, round(sum(w * f.value) / nullif(sum(w) FILTER (f.value IS NOT NULL), 0), 4) AS value
FROM n LEFT JOIN field f ON f.grid_id = n.grid_id AND f."row" = n.sr AND f.col = n.sc GROUP BY ALL""", "raw_field field")
def align_bilinear(spark, sf):
    return _aligned(spark, sf, "bilinear").withColumn("value", r6("value", 4))


_AREA_EVEN = {"gt": [4.0e6, 25.0, 0.0, 8.4e6, 0.0, -25.0], "epsg": 3857, "width": 64, "height": 250}
_AREA_ODD = {"gt": [37.0, 0.0004, 0.0, 62.0, 0.0, -0.0002], "epsg": 4326, "width": 64, "height": 250}


@query("object_area", _LABELS.format(limit=0.12) + """
, k AS (SELECT grid_id, label, CAST(substr(grid_id, 2) AS INTEGER) % 2 AS odd, "row" AS r FROM lab),
edge AS (SELECT *, CASE odd WHEN 0 THEN 2 * atan(exp((8.4e6 - 25 * r) / 6378137)) - pi() / 2 ELSE radians(62 - 0.0002::DOUBLE * r) END AS p1,
  CASE odd WHEN 0 THEN 2 * atan(exp((8.4e6 - 25 * (r + 1)) / 6378137)) - pi() / 2 ELSE radians(62 - 0.0002::DOUBLE * (r + 1)) END AS p2,
  CASE odd WHEN 0 THEN 25::DOUBLE / 6378137 ELSE radians(0.0004::DOUBLE) END AS l, 1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM k),
band AS (SELECT grid_id, label, odd, l, (1 - e2) * (sin(p1) / (1 - e2 * sin(p1) ** 2) - ln((1 - sqrt(e2) * sin(p1)) / (1 + sqrt(e2) * sin(p1))) / (2 * sqrt(e2)))
  - (1 - e2) * (sin(p2) / (1 - e2 * sin(p2) ** 2) - ln((1 - sqrt(e2) * sin(p2)) / (1 + sqrt(e2) * sin(p2))) / (2 * sqrt(e2))) AS q FROM edge),
sized AS (SELECT grid_id, label, odd, count(*) AS n_px, sum(6378137::DOUBLE ** 2 / 2 * l * q) AS m2 FROM band GROUP BY ALL),
cell AS (SELECT 0 AS odd, 625::DOUBLE AS one UNION ALL SELECT 1, 0.0004::DOUBLE * pi() / 180 * 6378137 * cos(p) * 0.0002::DOUBLE
  * (111132.954::DOUBLE - 559.822::DOUBLE * cos(2 * p) + 1.175::DOUBLE * cos(4 * p)) FROM (SELECT radians(62 - 0.0001::DOUBLE) AS p))
SELECT grid_id, label, n_px, round(m2 / 1e4, 4) AS area_ha FROM sized JOIN cell USING (odd) WHERE m2 >= 3 * one""", "raw_field")
def object_area(spark, sf):
    """Areas on the equal-area plane, of Mercator and of geographic grids, cut at three cells of the grid."""
    found = objects.measured(settle(_labelled(spark, sf, 0.12)), _grid_rows(spark, sf, _AREA_EVEN, _AREA_ODD), 3)
    return found.select("grid_id", "label", "n_px", r6("area_ha", 4).alias("area_ha"))


@query("tile_mosaic", """
SELECT 'mosaic' AS grid_id, CAST(vec_id AS INTEGER) AS "row", CAST(i - 1 AS INTEGER) AS col, round(CAST(v AS DOUBLE), 6) AS value
FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings)""")
def tile_mosaic(spark, sf):
    k = F.substring("grid_id", 2, 10).cast("int")
    pieces = V.raw_field(spark, sf).select(
        F.lit("mosaic").alias("grid_id"), "row", "col", r6("value").alias("value"), F.lit(0.0).alias("x0"), (10000.0 - k * 2500).alias("y0")
    )
    return resample.mosaic(pieces, {"gt": [0.0, 10.0, 0.0, 10000.0, 0.0, -10.0]})


@query("first_wins", """
, o AS (SELECT grid_id, "row", col, CASE WHEN period = 'post' THEN 0 ELSE value END AS value, scene_id || period || band AS ord FROM stack),
u AS (SELECT grid_id, "row", col, ord, max(value) AS value FROM o GROUP BY ALL)
SELECT grid_id, "row", col, round(arg_min(value, ord), 6) AS value FROM u WHERE value <> 0 GROUP BY grid_id, "row", col""", "stack")
def first_wins(spark, sf):
    ord_ = F.concat("scene_id", "period", "band")
    value = F.when(F.col("period") == "post", 0.0).otherwise(F.col("value"))
    scenes = V.stack(spark, sf).select(*CELL, ord_.alias("ord"), value.alias("value"))
    one = scenes.groupBy(*CELL, "ord").agg(F.max("value").alias("value"))
    return resample.first_wins(one, "ord").withColumn("value", r6("value"))


# -- polygons --------------------------------------------------------------------------------------

@query("burn_polygon", 'SELECT poly_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col FROM burnt', "diamonds diamond_points diamond_sides burnt")
def burn_polygon(spark, sf):
    return cover.burn(V.diamonds(spark, sf), ["poly_id"], SOURCE)


@query("burn_union", """
SELECT CAST(poly_id % 7 AS INTEGER) AS event_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col FROM burnt GROUP BY ALL""", "diamonds diamond_points diamond_sides burnt")
def burn_union(spark, sf):
    parts = V.diamonds(spark, sf).withColumn("event_id", (F.col("poly_id") % 7).cast("int"))
    return cover.burn_union(parts, ["event_id"], "poly_id", SOURCE)


@query("ring_measures", """
, a AS (SELECT poly_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, count(*) AS n_vertices, min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax
  FROM diamond_sides GROUP BY poly_id)
SELECT poly_id, round(area, 4) AS area, CAST(n_vertices AS INTEGER) AS n_vertices, round(xmin, 4) AS xmin, round(ymin, 4) AS ymin,
  round(xmax, 4) AS xmax, round(ymax, 4) AS ymax, round((xmin + xmax) / 2, 4) AS center_x FROM a""", "diamonds diamond_points diamond_sides")
def ring_measures(spark, sf):
    b = G.rings_bbox(F.col("rings"))
    d = V.diamonds(spark, sf).select("poly_id", r6(G.rings_area(F.col("rings")), 4).alias("area"), G.n_vertices(F.col("rings")).alias("n_vertices"), b.alias("b"))
    return d.select(
        "poly_id", "area", "n_vertices", *[r6(f"b.{c}", 4).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
        r6((F.col("b.xmin") + F.col("b.xmax")) / 2, 4).alias("center_x"),
    )


@query("convex_hull", """
SELECT poly_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 4) AS hull_area, CAST(count(*) AS INTEGER) AS n FROM diamond_sides GROUP BY poly_id""", "diamonds diamond_points diamond_sides")
def hulls(spark, sf):
    h = V.diamonds(spark, sf).withColumn("hull", convex_hull("rings"))
    return h.select("poly_id", r6(F.abs(G.ring_signed_area(F.col("hull"))), 4).alias("hull_area"), F.size("hull").alias("n"))


@query("convex_hull_inner", """
WITH p AS (SELECT DISTINCT s_suppkey AS poly_id, (s_suppkey * 31 + i * i * 17 + i * 7) % 23 AS x, (s_suppkey * 13 + i * i * i * 5 + i * 11) % 19 AS y FROM supplier, range(14) t(i)),
side AS (SELECT a.poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON a.poly_id = b.poly_id AND (a.x <> b.x OR a.y <> b.y)),
seen AS (SELECT side.*, (x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) AS turn, (p.x - x1) * (p.x - x2) + (p.y - y1) * (p.y - y2) AS between FROM side JOIN p USING (poly_id)),
hull AS (SELECT poly_id, x1, y1, x2, y2 FROM seen GROUP BY ALL HAVING bool_and(turn > 0 OR (turn = 0 AND between <= 0)))
SELECT poly_id, round(sum(x1 * y2 - x2 * y1) / 2.0, 4) AS hull_area, CAST(count(*) AS INTEGER) AS n FROM hull GROUP BY poly_id""")
def hulls_inner(spark, sf):
    """Fourteen scattered points a shape, most of them inside, some equal or on a side."""
    i, k = F.col("i"), F.col("s_suppkey")
    rows = V.table(spark, sf, "supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(13))).alias("i"))
    p = F.struct(
        ((k * 31 + i * i * 17 + i * 7) % 23).cast("double").alias("x"), ((k * 13 + i * i * i * 5 + i * 11) % 19).cast("double").alias("y")
    )
    h = rows.groupBy(k.alias("poly_id")).agg(F.array(F.collect_list(p)).alias("rings")).withColumn("hull", convex_hull("rings"))
    return h.select("poly_id", r6(G.ring_signed_area(F.col("hull")), 4).alias("hull_area"), F.size("hull").alias("n"))


@query("point_in_ring_share", """
, p AS (SELECT poly_id, cx - rx + (i + 0.5) * (2 * rx) / 11 AS x, cy - ry + (j + 0.5) * (2 * ry) / 11 AS y, i, j FROM diamonds, range(11) a(i), range(11) b(j)),
c AS (SELECT poly_id, i, j, count(*) FILTER ((y1 <= y) <> (y2 <= y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0)) % 2 = 1 AS hit
  FROM p JOIN diamond_sides USING (poly_id) GROUP BY ALL)
SELECT poly_id, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS share FROM c GROUP BY poly_id""", "diamonds diamond_points diamond_sides")
def point_in_ring_share(spark, sf):
    b = G.rings_bbox(F.col("rings"))
    d = V.diamonds(spark, sf).select("poly_id", F.get("rings", F.lit(0)).alias("ring"), b.alias("b")).select("poly_id", "ring", "b.*")
    return G.share_inside(d, ["poly_id"], 11).withColumn("share", r6("share"))


@query("box_coverage", """
SELECT s_suppkey AS poly_id, round(greatest(0, least(x0 + w, 400) - greatest(x0, 100)) * greatest(0, least(y0 + w, 1500) - greatest(y0, 200)) / (300.0 * 1300.0), 6) AS share
FROM (SELECT s_suppkey, s_suppkey * 37 % 640 AS x0, s_suppkey * 53 % 2500 AS y0, 100 + s_suppkey % 90 AS w FROM supplier)""")
def box_coverage(spark, sf):
    k = F.col("s_suppkey")
    x0, y0, w = (k * 37 % 640).cast("double"), (k * 53 % 2500).cast("double"), (k % 90 + 100).cast("double")
    ring = G.box_ring(x0, y0, x0 + w, y0 + w)
    box = [F.lit(v) for v in (100.0, 200.0, 400.0, 1500.0)]
    return V.table(spark, sf, "supplier").select(k.alias("poly_id"), r6(F.coalesce(G.box_coverage(ring, *box), F.lit(0.0))).alias("share"))


@query("granule_coverage", """
SELECT s_suppkey AS poly_id, round((s_suppkey % 21) / 20.0, 6) AS cov, 4 AS n_hull FROM supplier""")
def granule_coverage(spark, sf):
    """Slanted footprints with a notch, against rhombi with dented sides: a line parallel to a side cuts off its share of the hull."""
    k = F.col("s_suppkey")
    cx, cy, a, b, u = k % 100 + 0.37, k % 50 + 0.21, F.lit(4.3) + k % 6, F.lit(3.7) + k % 9, (k % 21) / 10 - 1
    p = lambda x, y: F.struct((cx + x).cast("double").alias("x"), (cy + y).cast("double").alias("y"))
    dented = F.array(p(-a, a * 0), p(-a * 0.2, b * 0.2), p(a * 0, b), p(a, b * 0), p(a * 0, -b))
    foot = F.array(p(u * a + 5 * a, -5 * b), p(u * a - 5 * a, 5 * b), p(u * a - 10 * a, b * 0), p(-3 * a, -3 * b), p(u * a, -10 * b))
    rows = V.table(spark, sf, "supplier").select(
        k.alias("event_id"), F.struct(foot.alias("as_given"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("swapped")).alias("rings"),
        convex_hull(F.array(dented)).alias("hull"),
    )
    covered = catalogs.coverage(rows.select("event_id", "rings"), rows.select("event_id", "hull"))
    out = covered.join(rows.select("event_id", F.size("hull").alias("n_hull")), "event_id")
    return out.select(F.col("event_id").alias("poly_id"), r6("cov").alias("cov"), "n_hull")


@query("ring_axis_order", """
SELECT s_suppkey AS id, CASE WHEN k % 2 = 0 THEN 'given' ELSE 'swapped' END AS reading FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)""")
def ring_axis_order(spark, sf):
    k = F.col("s_suppkey")
    lon, lat = (k % 20 + 100).cast("double"), (k % 30 + 20).cast("double")
    corner = lambda a, b: F.when(k % 2 == 0, F.concat_ws(" ", a, b)).otherwise(F.concat_ws(" ", b, a))
    text = F.concat_ws(" ", corner(lon, lat), corner(lon + 1, lat), corner(lon + 1, lat + 1), corner(lon, lat + 1))
    rows = V.table(spark, sf, "supplier").select(k.alias("id"), G.parse_ring(text).alias("r"), lon.alias("lon"), lat.alias("lat"))
    box = (F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1)
    picked = G.pick_ring_reading(F.col("r"), *box)
    return rows.select("id", F.when(picked == F.col("r.swapped"), "swapped").otherwise("given").alias("reading"))


_BOXES = """
, ev AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS date, (o_orderkey * 37 % 9900) + 0.25::DOUBLE AS x0, (o_orderkey * 91 % 9900) + 0.75::DOUBLE AS y0,
  20 + o_custkey % 80 AS w FROM orders),
st AS (SELECT s_suppkey AS site_id, (s_suppkey * 971 % 9500) + 0.5::DOUBLE AS x0, (s_suppkey * 613 % 9500) + 0.5::DOUBLE AS y0, 400 AS w,
  DATE '1996-01-01' + CAST(s_suppkey * 13 % 1500 AS INTEGER) AS d1 FROM supplier)""".replace(", ev", "WITH ev", 1)


def _event_boxes(spark, sf):
    k = F.col("o_orderkey")
    x0, y0, w = (k * 37 % 9900) + 0.25, (k * 91 % 9900) + 0.75, F.col("o_custkey") % 80 + 20
    rows = V.table(spark, sf, "orders").select(
        k.alias("event_id"), F.to_date("o_orderdate").alias("date"), x0.alias("xmin"), y0.alias("ymin"), (x0 + w).alias("xmax"), (y0 + w).alias("ymax")
    )
    return rows.withColumn("rings", F.array(G.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])))


def _site_boxes(spark, sf):
    k = F.col("s_suppkey")
    x0, y0 = (k * 971 % 9500) + 0.5, (k * 613 % 9500) + 0.5
    d1 = F.date_add(F.lit("1996-01-01").cast("date"), (k * 13 % 1500).cast("int"))
    rows = V.table(spark, sf, "supplier").select(
        k.alias("site_id"), d1.alias("d1"), F.lit(None).cast("date").alias("d2"), x0.alias("xmin"), y0.alias("ymin"), (x0 + 400).alias("xmax"), (y0 + 400).alias("ymax")
    )
    return rows.withColumn("rings", F.array(G.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])))


@query("near_events", _BOXES + """
SELECT site_id, event_id FROM st s JOIN ev e ON s.x0 - 15 <= e.x0 + e.w AND s.x0 + 415 >= e.x0 AND s.y0 - 15 <= e.y0 + e.w AND s.y0 + 415 >= e.y0""")
def near_events(spark, sf):
    return cover.near_events(_event_boxes(spark, sf), _site_boxes(spark, sf), 15.0, 500.0)


@query("site_match", _BOXES + """
, m AS (SELECT site_id, event_id, (ceil((least(s.x0 + 400, e.x0 + e.w)) / 10 - 0.5) - ceil(greatest(s.x0, e.x0) / 10 - 0.5))
    * (ceil(least(s.y0 + 400, e.y0 + e.w) / 10 - 0.5) - ceil(greatest(s.y0, e.y0) / 10 - 0.5)) AS i,
  (ceil((s.x0 + 400) / 10 - 0.5) - ceil(s.x0 / 10 - 0.5)) * (ceil((s.y0 + 400) / 10 - 0.5) - ceil(s.y0 / 10 - 0.5)) AS a,
  (ceil((e.x0 + e.w) / 10 - 0.5) - ceil(e.x0 / 10 - 0.5)) * (ceil((e.y0 + e.w) / 10 - 0.5) - ceil(e.y0 / 10 - 0.5)) AS b
  FROM st s JOIN ev e ON s.x0 <= e.x0 + e.w AND s.x0 + 400 >= e.x0 AND s.y0 <= e.y0 + e.w AND s.y0 + 400 >= e.y0
  AND e.date BETWEEN d1 - 30 AND d1 + 30),
r AS (SELECT *, i / (a + b - i) AS iou, row_number() OVER (PARTITION BY site_id ORDER BY i / (a + b - i) DESC, event_id) AS rank FROM m WHERE i > 0)
SELECT site_id, event_id, round(i * 100 / 1e4, 6) AS inter_ha, round(iou, 6) AS iou, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def site_match(spark, sf):
    from deltacell.plans.sites import site_matches

    grid = {"gt": [0.0, 10.0, 0.0, 10000.0, 0.0, -10.0], "width": 1000, "height": 1000}
    m = site_matches(_site_boxes(spark, sf), _event_boxes(spark, sf), "rings", "rings", grid, 100.0, bucket=500.0)
    return m.select("site_id", "event_id", r6("inter_ha").alias("inter_ha"), r6("iou").alias("iou"), "rank")


@query("cluster_half_degree", """
WITH p AS (SELECT o_custkey % 50 AS event_id, o_orderkey % 97 / 20 AS xmin, o_orderkey % 89 / 25 AS ymin, 0.125 + o_orderkey % 97 / 20 AS xmax,
  0.25 + o_orderkey % 89 / 25 AS ymax, floor(o_totalprice) AS area FROM orders),
b AS (SELECT event_id, round_even((xmin + xmax) / 2 / 0.5, 0) AS bx, round_even((ymin + ymax) / 2 / 0.5, 0) AS "by", sum(area) AS area, count(*) AS n_parts,
  min(xmin) AS x0, min(ymin) AS y0, max(xmax) AS x1, max(ymax) AS y1 FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY area DESC, bx, "by") AS k, sum(n_parts) OVER (PARTITION BY event_id) AS total FROM b)
SELECT event_id, bx, "by", area, n_parts, CAST(total AS BIGINT) AS n_parts_total, round(x0 - 0.25, 6) AS xmin, round(y0 - 0.25, 6) AS ymin,
  round(x1 + 0.25, 6) AS xmax, round(y1 + 0.25, 6) AS ymax FROM r WHERE k = 1""")
def cluster_half_degree(spark, sf):
    k = F.col("o_orderkey")
    x, y = k % 97 / 20, k % 89 / 25
    parts = V.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).alias("event_id"), x.alias("xmin"), y.alias("ymin"), (x + 0.125).alias("xmax"), (y + 0.25).alias("ymax"),
        F.floor("o_totalprice").cast("double").alias("area"),
    )
    c = cover.centroid_clusters(parts)
    return c.select("event_id", "bx", "by", "area", "n_parts", "n_parts_total", *[r6(v).alias(v) for v in ("xmin", "ymin", "xmax", "ymax")])


# -- grids and coordinates ---------------------------------------------------------------------------

_LONLAT = "SELECT c_custkey AS id, -175 + (c_custkey * 7919 % 3500) / 10 AS lon, -55 + (c_custkey * 104729 % 1300) / 10 AS lat FROM customer"


def _lonlat(spark, sf):
    k = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(
        k.alias("id"), ((k * 7919 % 3500) / 10 - 175).alias("lon"), ((k * 104729 % 1300) / 10 - 55).alias("lat")
    )


@query("utm_zone", f"SELECT id, CAST(32600 + floor((lon + 180) / 6) + 1 AS INTEGER) AS epsg FROM ({_LONLAT})")
def utm_zone(spark, sf):
    return _lonlat(spark, sf).select("id", crs.utm_epsg(F.col("lon")).alias("epsg"))


_N = crs._N
_TM_SQL = f"""
WITH p AS (SELECT id, lon, lat, floor((lon + 180) / 6) + 1 AS zone FROM ({_LONLAT})),
q AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sin(radians(lat)) AS s FROM p),
u AS (SELECT *, sinh(0.5 * ln((1 + s) / (1 - s)) - {crs.ECC!r}::DOUBLE * 0.5 * ln((1 + {crs.ECC!r}::DOUBLE * s) / (1 - {crs.ECC!r}::DOUBLE * s))) AS t FROM q),
v AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM u)
SELECT id, round(500000 + 0.9996::DOUBLE * {crs._RADIUS!r}::DOUBLE * (eta{''.join(f" + {c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(crs._FORWARD, 1))}), 3) AS x,
  round(CASE WHEN lat < 0 THEN 1e7 ELSE 0 END + 0.9996::DOUBLE * {crs._RADIUS!r}::DOUBLE * (xi{''.join(f" + {c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(crs._FORWARD, 1))}), 3) AS y FROM v"""


@query("lonlat_to_utm", _TM_SQL)
def lonlat_to_utm(spark, sf):
    x, y = crs.lonlat_to_utm(F.col("lon"), F.col("lat"), crs.utm_epsg(F.col("lon"), F.col("lat")))
    return _lonlat(spark, sf).select("id", r6(x, 3).alias("x"), r6(y, 3).alias("y"))


@query("utm_round_trip", f"SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({_LONLAT})")
def utm_round_trip(spark, sf):
    zone = crs.utm_epsg(F.col("lon"), F.col("lat"))
    x, y = crs.lonlat_to_utm(F.col("lon"), F.col("lat"), zone)
    there = _lonlat(spark, sf).select("id", x.alias("x"), y.alias("y"), zone.alias("zone"))
    lon, lat = crs.utm_to_lonlat(F.col("x"), F.col("y"), F.col("zone"))
    return there.select("id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("equal_area", f"""
SELECT id, round({crs.A!r}::DOUBLE * {crs._EASE_K!r}::DOUBLE * radians(lon), 3) AS x, round({crs.A!r}::DOUBLE * (1 - {crs.E2!r}::DOUBLE) * (s / (1 - {crs.E2!r}::DOUBLE * s * s)
  - 1 / (2 * {crs.ECC!r}::DOUBLE) * ln((1 - {crs.ECC!r}::DOUBLE * s) / (1 + {crs.ECC!r}::DOUBLE * s))) / (2 * {crs._EASE_K!r}::DOUBLE), 3) AS y
FROM (SELECT *, sin(radians(lat)) AS s FROM ({_LONLAT}))""")
def equal_area(spark, sf):
    x, y = crs.lonlat_to_equal_area(F.col("lon"), F.col("lat"))
    return _lonlat(spark, sf).select("id", r6(x, 3).alias("x"), r6(y, 3).alias("y"))


@query("web_mercator", f"""
SELECT id, round(6378137.0 * radians(lon), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM ({_LONLAT})""")
def web_mercator(spark, sf):
    x, y = crs.lonlat_to_mercator(F.col("lon"), F.col("lat"))
    return _lonlat(spark, sf).select("id", r6(x, 3).alias("x"), r6(y, 3).alias("y"))


@query("tiles_for_bbox", f"""
WITH b AS (SELECT id, lon AS xmin, lat AS ymin, lon + 3.3 + id % 17 AS xmax, least(lat + 2.7 + id % 12, 80) AS ymax FROM ({_LONLAT})),
t AS (SELECT id, unnest(generate_series(CAST(ceil(ymax / 10) * 10 AS BIGINT), CAST(floor(ymin / 10) * 10 + 10 AS BIGINT), -10)) AS lat, xmin, xmax, ymax FROM b),
u AS (SELECT *, unnest(generate_series(CAST(floor(xmin / 10) * 10 AS BIGINT), CAST(ceil(xmax / 10) * 10 - 10 AS BIGINT), 10)) AS lon FROM t)
SELECT id, lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || '_' || lpad(CAST(abs(lon) AS VARCHAR), 3, '0')
  || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END AS tile, CAST((ceil(ymax / 10) * 10 - lat) / 10 AS INTEGER) AS tile_row,
  CAST((lon - floor(xmin / 10) * 10) / 10 AS INTEGER) AS tile_col FROM u""")
def tiles_for_bbox(spark, sf):
    p = _lonlat(spark, sf).select(
        "id", F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), (F.col("lon") + 3.3 + F.col("id") % 17).alias("xmax"),
        F.least(F.col("lat") + 2.7 + F.col("id") % 12, F.lit(80.0)).alias("ymax"),
    )
    return G.tiles_for_bbox(p).select("id", "tile", "tile_row", "tile_col")


@query("snap_grid", f"""
WITH b AS (SELECT id, lon * 1000 AS x0, lat * 1000 AS y0, lon * 1000 + 123.4 AS x1, lat * 1000 + 77.7 AS y1 FROM ({_LONLAT}))
SELECT id, floor((x0 - 3100) / 10) * 10 AS xmin, floor((y0 - 3100) / 10) * 10 AS ymin, (floor((x1 + 3100) / 10) + 1) * 10 AS xmax,
  (floor((y1 + 3100) / 10) + 1) * 10 AS ymax, CAST(round(((floor((x1 + 3100) / 10) + 1) * 10 - floor((x0 - 3100) / 10) * 10) / 10) AS INTEGER) AS width,
  CAST(round(((floor((y1 + 3100) / 10) + 1) * 10 - floor((y0 - 3100) / 10) * 10) / 10) AS INTEGER) AS height FROM b""")
def snap_grid(spark, sf):
    x, y = F.col("lon") * 1000, F.col("lat") * 1000
    snapped = G.snap_bounds(x, y, x + 123.4, y + 77.7, 10.0, 3100.0)
    return _lonlat(spark, sf).select("id", snapped.alias("s")).select("id", "s.*")


@query("pixel_area", f"""
WITH b AS (SELECT id, radians(greatest(-89.5, least(89.5, lat - 0.00025 * 0.5))) AS p FROM ({_LONLAT}))
SELECT id, round(0.00025 * pi() / 180 * 6378137.0 * cos(p) * 0.00025 * (111132.954 - 559.822 * cos(2 * p) + 1.175 * cos(4 * p)), 6) AS geographic,
  100.0::DOUBLE AS projected FROM b""")
def pixel_area(spark, sf):
    gt = F.array(F.col("lon"), F.lit(0.00025), F.lit(0.0), F.col("lat"), F.lit(0.0), F.lit(-0.00025))
    flat = F.array(*[F.lit(v) for v in (500000.0, 10.0, 0.0, 5000000.0, 0.0, -10.0)])
    return _lonlat(spark, sf).select(
        "id", r6(G.cell_area_m2(gt, F.lit(4326))).alias("geographic"), G.cell_area_m2(flat, F.lit(32633)).alias("projected")
    )


@query("grid_checks", """
SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS same, s_suppkey % 3 <> 2 AS aligned FROM supplier""")
def grid_checks(spark, sf):
    k = F.col("s_suppkey")
    def grid(shift):
        gt = F.array(shift, F.lit(10.0), F.lit(0.0), F.lit(5000000.0), F.lit(0.0), F.lit(-10.0))
        return F.struct(F.lit(64).alias("width"), F.lit(64).alias("height"), gt.alias("gt"), F.lit(32633).alias("epsg"))

    other = F.lit(500000.0) + F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 20.0).otherwise(3.0)
    rows = V.table(spark, sf, "supplier").select(k.alias("id"), grid(F.lit(500000.0)).alias("a"), grid(other).alias("b"))
    return rows.select("id", G.same_grid(F.col("a"), F.col("b")).alias("same"), G.aligned(F.col("a"), F.col("b")).alias("aligned"))
