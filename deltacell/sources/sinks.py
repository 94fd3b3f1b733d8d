"""Writers: cell tables, objects, reports and catalogues."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltacell.functions import geometry as G
from deltacell.operators.focal import TILE, tile_of
from deltacell.operators.masks import check_grid
from deltacell.session import settle


#: Tiles along the side of a block; a block of cells is one file.
BLOCK = 16


def curve(row: Column, col: Column, bits: int = 4) -> Column:
    """Place on a Z-shaped curve through a block's tiles, from the last ``bits`` of their numbers."""
    out = F.lit(0)
    for i in range(bits):
        for place, number in ((2 * i + 1, row), (2 * i, col)):
            out = out + F.shiftleft(F.shiftright(number, i).bitwiseAND(F.lit(1)), place)
    return out


def write_index(index: DataFrame, path: str, nodata: float | None = None, tile: int = TILE, block: int = BLOCK) -> None:
    """Index cells by grid and block of tiles, so that a window read opens only the blocks it touches.

    A block is one folder and one file of bounded size; inside, tiles follow a Z-shaped curve, so that
    the statistics of a file's pages tell tiles apart too. ``sources.tables.read_window`` uses both.
    NULL marks no data; ``nodata`` writes the sentinel for readers that want one.
    """
    out = index if nodata is None else index.withColumn("value", F.coalesce("value", F.lit(float(nodata))))
    laid = out.withColumn("tile_row", tile_of("row", tile)).withColumn("tile_col", tile_of("col", tile))
    laid = laid.withColumn("block_row", F.floor(F.col("tile_row") / block).cast("int")).withColumn("block_col", F.floor(F.col("tile_col") / block).cast("int"))
    key = ["grid_id", "block_row", "block_col"]
    placed = laid.repartition(*key).sortWithinPartitions(*key, curve(F.col("tile_row"), F.col("tile_col"), max(1, (block - 1).bit_length())), "row", "col")
    placed.write.mode("overwrite").partitionBy(*key).parquet(path)


def write_mask(mask: DataFrame, grids: DataFrame, path: str) -> None:
    """Kept cells only; a cell outside its grid stops the job."""
    check_grid(mask, grids).write.mode("overwrite").partitionBy("grid_id").parquet(path)


def write_objects(objects: DataFrame, path: str) -> None:
    objects.write.mode("overwrite").parquet(path)


def write_composites(obs: DataFrame, composites: DataFrame, path: str) -> None:
    """Composites of (grid, period, band) groups that have more than one scene."""
    key = ["grid_id", "period", "band"]
    stacked = obs.groupBy(*key).agg(F.count_distinct("scene_id").alias("n")).where("n > 1").select(*key)
    composites.join(stacked, key, "left_semi").write.mode("overwrite").partitionBy("grid_id").parquet(path)


def _geometry(rings: Column) -> Column:
    closed = lambda r: F.concat(
        F.transform(r, lambda p: F.array(p["x"], p["y"])), F.array(F.array(r[0]["x"], r[0]["y"]))
    )
    polygons = F.transform(G.nested_polygons(rings), lambda p: F.transform(p, closed))
    return F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))


def site_features(sites: DataFrame, rings: str = "rings") -> DataFrame:
    """One GeoJSON feature per row, every other column nested under properties."""
    props = F.struct(*[F.col(c) for c in sites.columns if c != rings])
    feature = F.struct(F.lit("Feature").alias("type"), _geometry(F.col(rings)).alias("geometry"), props.alias("properties"))
    return sites.select(F.to_json(feature).alias("value"))


def write_sites(sites: DataFrame, path: str, rings: str = "rings") -> None:
    """Features one per line (GeoJSON text sequence), written by all tasks."""
    site_features(sites, rings).write.mode("overwrite").text(path)


#: Text of a FeatureCollection, about.
DOC_BYTES = 8 * 1024 * 1024


def _collection(batches):
    """Text of one FeatureCollection per task: its features, each on a line, between an opening and a closing line."""
    yield pa.record_batch([pa.array(['{"type":"FeatureCollection","features":['])], names=["value"])
    begun = False
    for batch in batches:
        lines = [("," if begun or k else "") + v for k, v in enumerate(batch.column(0).to_pylist())]
        begun = begun or bool(lines)
        yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])
    yield pa.record_batch([pa.array(["]}"])], names=["value"])


def write_collection(sites: DataFrame, path: str, rings: str = "rings", doc_bytes: int = DOC_BYTES) -> None:
    """A GeoJSON FeatureCollection in every file, one file a task; a single task's table is one document.

    A document is read whole by one task, so features of more than ``doc_bytes`` in all are dealt
    evenly to documents of about that size.
    """
    features = settle(site_features(sites, rings))
    size = features.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > doc_bytes:
        features = features.repartition(-(-size // doc_bytes))
    features.mapInArrow(_collection, "value string").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """Files with a header line; each begins with a byte-order mark, by which spreadsheets know UTF-8."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "\ufeff" + first) if bom else df
    out.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def run_report(metrics: DataFrame, parameters: Mapping[str, object]) -> DataFrame:
    """Metrics with their parameters and a status that claims nothing beyond a candidate map."""
    params = F.create_map(*[F.lit(str(v)) for kv in sorted(parameters.items()) for v in kv])
    return metrics.withColumn("parameters", params).withColumn("status", F.lit("candidate_map_unvalidated"))


def write_report(metrics: DataFrame, parameters: Mapping[str, object], path: str) -> None:
    run_report(metrics, parameters).write.mode("overwrite").json(path)


def merge_status(sites: DataFrame, results: DataFrame, reserve: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """Site catalogue after a run.

    Shortlisted sites with a result become processed and carry it; shortlisted sites on the
    reserve list become reserve; rows of ``added`` whose id is new are appended.
    """
    named = results.select("id", F.struct(*[c for c in results.columns if c != "id"]).alias("_res"))
    out = sites.join(named, "id", "left")
    if reserve is not None:
        out = out.join(reserve.select("id", F.lit(True).alias("_rsv")), "id", "left")
    else:
        out = out.withColumn("_rsv", F.lit(None).cast("boolean"))
    short = F.col("status") == "shortlisted"
    done = short & F.col("_res").isNotNull()
    status = F.when(done, "processed").when(short & F.col("_rsv"), "reserve").otherwise(F.col("status"))
    out = out.withColumn("result", F.when(done, F.col("_res"))).withColumn("status", status).drop("_res", "_rsv")
    if added is not None:
        fresh = added.join(sites.select("id"), "id", "left_anti")
        out = out.unionByName(fresh, allowMissingColumns=True)
    return out


