"""Tables written and read back: every writer and reader over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query, r6
from checks.shapes import _LABELS, SOURCE, TILE, _grid_rows, _labelled
from deltacell import schema as S
from deltacell.functions import geometry as G
from deltacell.operators import screening, stack
from deltacell.session import scratch_root, settle
from deltacell.sources import catalogs, sinks, tables

CELL = ["grid_id", "row", "col"]
_CELLS = "grid_id STRING, row INT, col INT, value DOUBLE"


def _place(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("stored_cells", 'SELECT grid_id, "row", col, round(value, 6) AS value FROM field', "raw_field field")
def stored_cells(spark, sf):
    path = _place(spark, "cells")
    sinks.write_index(V.field(spark, sf), path, nodata=S.INDEX_NODATA)
    return tables.read_cells(spark, path, _CELLS, sentinels=[S.INDEX_NODATA]).withColumn("value", r6("value"))


@query("stored_grids", """
SELECT DISTINCT grid_id, 64 AS width, 250 AS height, CASE CAST(substr(grid_id, 2) AS INTEGER) % 2 WHEN 0 THEN 32633 ELSE 4326 END AS epsg,
  CASE CAST(substr(grid_id, 2) AS INTEGER) % 2 WHEN 0 THEN 10.0::DOUBLE ELSE 0.0001::DOUBLE END AS step FROM field""", "raw_field field")
def stored_grids(spark, sf):
    path = _place(spark, "grids")
    odd = {"gt": [15.0, 0.0001, 0.0, 45.0, 0.0, -0.0001], "epsg": 4326, "width": 64, "height": 250}
    _grid_rows(spark, sf, SOURCE, odd).write.parquet(path)
    return tables.read_grids(spark, path).select("grid_id", "width", "height", "epsg", F.col("gt")[1].alias("step"))


@query("stored_mask", 'SELECT grid_id, "row", col FROM raw_field WHERE value > 0.1', "raw_field")
def stored_mask(spark, sf):
    path = _place(spark, "mask")
    mask = V.raw_field(spark, sf).where("value > 0.1").select(*CELL)
    grids = mask.select("grid_id").distinct().select("grid_id", F.lit(250).alias("height"), F.lit(64).alias("width"))
    sinks.write_mask(mask, grids, path)
    return spark.read.parquet(path).select(*CELL)


@query("stored_objects", _LABELS.format(limit=0.15) + """
SELECT grid_id, label, count(*) AS n_px, round(count(*) * 0.01::DOUBLE, 6) AS area_ha FROM lab GROUP BY grid_id, label""", "raw_field")
def stored_objects(spark, sf):
    from deltacell.operators import objects

    path = _place(spark, "objects")
    sinks.write_objects(objects.object_stats(settle(_labelled(spark, sf)), 100.0), path)
    return spark.read.parquet(path).select("grid_id", "label", "n_px", r6("area_ha").alias("area_ha"))


@query("stored_composites", """
, many AS (SELECT grid_id, period, band FROM stack GROUP BY ALL HAVING count(DISTINCT scene_id) > 1)
SELECT grid_id, period, band, "row", col, round(median(v), 6) AS value FROM db JOIN many USING (grid_id, period, band) GROUP BY ALL""", "stack db")
def stored_composites(spark, sf):
    path = _place(spark, "composites")
    obs = stack.to_decibels(V.stack(spark, sf))
    sinks.write_composites(obs, stack.median_composite(obs), path)
    return spark.read.parquet(path).select("grid_id", "period", "band", "row", "col", r6("value").alias("value"))


_SITE_SQL = """
, r AS (SELECT poly_id, count(*) AS n_points, round(min(x), 4) AS xmin, round(max(y), 4) AS ymax FROM diamond_points GROUP BY poly_id)
SELECT poly_id + 1 AS id, 2000 + poly_id % 20 AS year, n_points + {closing} AS n_points, xmin, ymax FROM r"""


def _sites(spark, sf):
    k = F.col("poly_id")
    return V.diamonds(spark, sf).select((k + 1).cast("int").alias("id"), (2000 + k % 20).cast("int").alias("year"), "rings")


@query("stored_sites", _SITE_SQL.format(closing=1), "diamonds diamond_points")
def stored_sites(spark, sf):
    """Features, one a line, parsed again."""
    path = _place(spark, "sites")
    sinks.write_sites(_sites(spark, sf), path)
    schema = "type string, geometry struct<type:string,coordinates:array<array<array<array<double>>>>>, properties struct<id:bigint,year:bigint>"
    f = spark.read.schema(schema).json(path)
    ring = F.col("geometry.coordinates")[0][0]
    axis = lambda k: F.transform(ring, lambda p: p[k])
    return f.select(
        F.col("properties.id").alias("id"), F.col("properties.year").alias("year"), F.size(ring).cast("long").alias("n_points"),
        F.round(F.array_min(axis(0)), 4).alias("xmin"), F.round(F.array_max(axis(1)), 4).alias("ymax"),
    )


@query("stored_collection", _SITE_SQL.format(closing=1), "diamonds diamond_points")
def stored_collection(spark, sf):
    """FeatureCollections written by all tasks and read by the catalogue reader."""
    path = _place(spark, "collection")
    sinks.write_collection(_sites(spark, sf), path)
    s = catalogs.read_sites(spark, path)
    ring = F.col("rings")[0]
    return s.select(
        F.col("id").cast("long").alias("id"), F.col("year").cast("long").alias("year"), F.size(ring).cast("long").alias("n_points"),
        F.round(F.array_min(F.transform(ring, lambda p: p["x"])), 4).alias("xmin"), F.round(F.array_max(F.transform(ring, lambda p: p["y"])), 4).alias("ymax"),
    )


@query("stored_csv", "SELECT id, type, CAST(year AS INTEGER) AS year, area_km2, region FROM catalogue", "catalogue")
def stored_csv(spark, sf):
    path = _place(spark, "csv")
    sinks.write_csv(V.catalogue(spark, sf).select("id", "type", "year", "area_km2", "region"), path)
    return spark.read.option("header", "true").schema("id BIGINT, type STRING, year INT, area_km2 DOUBLE, region STRING").csv(path)


@query("stored_report", """
SELECT grid_id, round(avg(value), 6) AS mean, 'candidate_map_unvalidated' AS status, 'adaptive' AS mode FROM field GROUP BY grid_id""", "raw_field field")
def stored_report(spark, sf):
    path = _place(spark, "report")
    m = V.field(spark, sf).groupBy("grid_id").agg(r6(F.avg("value")).alias("mean"))
    sinks.write_report(m, {"mode": "adaptive"}, path)
    r = spark.read.schema("grid_id STRING, mean DOUBLE, status STRING, parameters MAP<STRING, STRING>").json(path)
    return r.select("grid_id", "mean", "status", F.col("parameters")["mode"].alias("mode"))


@query("stored_events", """
SELECT CAST(id AS INTEGER) AS id, type, CAST(year AS INTEGER) AS year, CASE WHEN id % 7 <> 0 THEN area_km2 END AS area_km2,
  CASE WHEN id % 5 <> 0 THEN certainty END AS certainty FROM catalogue""", "catalogue")
def stored_events(spark, sf):
    """An event layer with -9999 for what is missing, in numbers and in text."""
    path = _place(spark, "events")
    k = F.col("id")
    V.catalogue(spark, sf).select(
        k.cast("int").alias("id"), "type", F.col("year").cast("int").alias("year"),
        F.when(k % 7 == 0, -9999.0).otherwise(F.col("area_km2")).alias("area_km2"), F.when(k % 5 == 0, "-9999").otherwise(F.col("certainty")).alias("certainty"),
    ).write.parquet(path)
    return tables.read_events(spark, path).select("id", "type", "year", "area_km2", "certainty")


@query("stored_legacy", """
SELECT CAST(id AS INTEGER) AS id, round(area_km2, 3) AS area, CASE WHEN id % 9 <> 0 THEN round(wind_gust * 1.5::DOUBLE, 1) END AS gust FROM catalogue""", "catalogue")
def stored_legacy(spark, sf):
    """Semicolon text in a one-byte encoding, decimal commas, a preamble of two lines and comment rows, one file a task."""
    path = _place(spark, "legacy")
    comma = lambda c, n: F.replace(F.format_string(f"%.{n}f", c), F.lit("."), F.lit(","))
    gust = F.when(F.col("id") % 9 == 0, "n/a").otherwise(comma(F.col("wind_gust") * F.lit(1.5), 1))
    rows = V.catalogue(spark, sf).select(F.concat_ws(";", F.col("id").cast("string"), comma(F.round("area_km2", 3), 3), gust).alias("value"))

    def framed(batches):
        import pyarrow as pa

        head = " № ;Площадь;gust".encode("windows-1251").decode("iso-8859-1")  # the writer knows the latter only
        yield pa.record_batch([pa.array(["a table", "made for a test", head, "/* units */;;"])], names=["value"])
        for batch in batches:
            yield pa.record_batch([pa.array(batch.column(0).to_pylist(), pa.string())], names=["value"])

    rows.mapInArrow(framed, "value string").write.option("encoding", "iso-8859-1").option("quote", "\x00").option("sep", "\x01").csv(path)
    return tables.read_legacy_csv(spark, path, {"№": "id INT", "Площадь": "area DOUBLE", "gust": "gust DOUBLE"}, header_line=2).drop("path", "line")


@query("listed_files", "SELECT count(DISTINCT grid_id) AS n_grids, count(DISTINCT grid_id) > 0 AS any_bytes FROM field", "raw_field field")
def listed_files(spark, sf):
    """The files below a written table name its grids."""
    path = _place(spark, "listed")
    V.field(spark, sf).repartition("grid_id").write.partitionBy("grid_id").parquet(path)
    files = tables.list_files(spark, path).where(F.col("path").endswith(".parquet"))
    grid = F.regexp_extract("path", r"grid_id=([^/]+)/", 1)
    return files.agg(F.count_distinct(grid).alias("n_grids"), (F.sum("length") > 0).alias("any_bytes"))


@query("grid_bbox", """
, g AS (SELECT DISTINCT grid_id, CAST(substr(grid_id, 2) AS INTEGER) AS k FROM field)
SELECT grid_id, round(degrees((1e6 + 1000 * k) / 6378137), 8) AS xmin, round(degrees((1e6 + 1000 * k + 640) / 6378137), 8) AS xmax,
  round(degrees(2 * atan(exp((5e6 - 2500) / 6378137)) - pi() / 2), 8) AS ymin, round(degrees(2 * atan(exp(5e6 / 6378137)) - pi() / 2), 8) AS ymax FROM g""", "raw_field field")
def grid_bbox(spark, sf):
    k = F.substring("grid_id", 2, 10).cast("int")
    gt = F.array(1e6 + 1000.0 * k, F.lit(10.0), F.lit(0.0), F.lit(5e6), F.lit(0.0), F.lit(-10.0))
    grids = V.field(spark, sf).select("grid_id").distinct().select("grid_id", F.lit(64).alias("width"), F.lit(250).alias("height"), gt.alias("gt"))
    b = G.grid_bbox_lonlat(grids, 3857)
    return b.select("grid_id", *[F.round(c, 8).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@query("truncated", """
SELECT region, count(*) > 100 AS over_100 FROM catalogue GROUP BY region ORDER BY region LIMIT 3""", "catalogue")
def truncated(spark, sf):
    """Whether each of the first three regions has more rows than a listing of 100 would show."""
    e = V.catalogue(spark, sf)
    names = [r[0] for r in e.select("region").distinct().orderBy("region").limit(3).collect()]
    rows = [(n, screening.is_truncated(e.where(F.col("region") == n), 100)) for n in names]
    return spark.createDataFrame(rows, "region string, over_100 boolean")
