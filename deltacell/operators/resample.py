"""Moving cells between grids. Grids are dicts with gt, epsg, width and height."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltacell import schema as S
from deltacell.functions import crs
from deltacell.functions import geometry as G

CELL = ["grid_id", "row", "col"]


def target_cells(grids: DataFrame, target: dict) -> DataFrame:
    """Every cell of the target grid for each grid id, laid out by row."""
    rows = grids.select("grid_id").distinct().select(
        "grid_id", F.explode(F.sequence(F.lit(0), F.lit(target["height"] - 1))).alias("row")
    )
    cols = F.explode(F.sequence(F.lit(0), F.lit(target["width"] - 1))).alias("col")
    return rows.repartition("grid_id", "row").select("grid_id", "row", cols)


def _source_xy(source: dict, target: dict) -> tuple[Column, Column]:
    x, y = G.cell_center(F.col("row"), F.col("col"), target["gt"])
    return crs.reproject(x, y, target["epsg"], source["epsg"])


def same(source: dict, target: dict, tol: float = 1e-9) -> bool:
    close = all(abs(a - b) <= tol for a, b in zip(source["gt"], target["gt"]))
    return close and all(source[k] == target[k] for k in ("epsg", "width", "height"))


def nearest(cells: DataFrame, source: dict, target: dict, grids: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Value of the source cell that holds each target centre; NULL outside the source."""
    if same(source, target):
        return cells
    ids = cells if grids is None else grids
    wanted = target_cells(ids, target)
    r, c = G.point_to_cell(*_source_xy(source, target), source["gt"])
    asked = wanted.withColumn("_sr", r).withColumn("_sc", c)
    lookup = cells.select("grid_id", F.col("row").alias("_sr"), F.col("col").alias("_sc"), value)
    return asked.join(lookup, ["grid_id", "_sr", "_sc"], "left").select(*CELL, value)


def bilinear(cells: DataFrame, source: dict, target: dict, grids: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Weighted mean of the four source cells around each target centre, over the known ones."""
    if same(source, target):
        return cells
    ids = cells if grids is None else grids
    gt = source["gt"]
    x, y = _source_xy(source, target)
    fc, fr = (x - gt[0]) / gt[1] - 0.5, (y - gt[3]) / gt[5] - 0.5
    placed = target_cells(ids, target).withColumn("_fr", fr).withColumn("_fc", fc)
    fr, fc = F.col("_fr"), F.col("_fc")
    r0, c0 = F.floor(fr), F.floor(fc)
    four = F.array(*[
        F.struct(
            (r0 + dr).cast("int").alias("r"), (c0 + dc).cast("int").alias("c"),
            ((fr - r0) if dr else (1 - (fr - r0))).alias("wr"), ((fc - c0) if dc else (1 - (fc - c0))).alias("wc"),
        )
        for dr in (0, 1)
        for dc in (0, 1)
    ])
    near = placed.select(*CELL, F.explode(four).alias("_n")).select(
        *CELL, F.col("_n.r").alias("_sr"), F.col("_n.c").alias("_sc"), (F.col("_n.wr") * F.col("_n.wc")).alias("_w")
    ).where(F.col("_w") > 0)
    lookup = cells.select("grid_id", F.col("row").alias("_sr"), F.col("col").alias("_sc"), F.col(value).alias("_v"))
    met = near.join(lookup, ["grid_id", "_sr", "_sc"], "left")
    weight = F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")))
    return met.groupBy(*CELL).agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), weight).alias(value))


def average(cells: DataFrame, source: dict, target: dict, value: str = "value") -> DataFrame:
    """Mean of the source cells whose centre falls in each target cell. Only occupied cells appear."""
    x, y = G.cell_center(F.col("row"), F.col("col"), source["gt"])
    r, c = G.point_to_cell(*crs.reproject(x, y, source["epsg"], target["epsg"]), target["gt"])
    placed = cells.select("grid_id", r.alias("row"), c.alias("col"), F.col(value).cast("double").alias("_v"))
    inside = F.col("row").between(0, target["height"] - 1) & F.col("col").between(0, target["width"] - 1)
    return placed.where(inside).groupBy(*CELL).agg(F.avg("_v").alias(value))


def fraction_mask(cells: DataFrame, source: dict, target: dict, flag: str, fraction: float = S.FOREST_FRACTION) -> DataFrame:
    """Target cells in which at least ``fraction`` of the source cells carry the flag."""
    share = average(cells.withColumn("_on", F.col(flag).cast("double")), source, target, "_on")
    return share.where(F.col("_on") >= fraction).select(*CELL)


def window(cells: DataFrame, bbox: Sequence[float], grid: dict) -> DataFrame:
    """Cells of a bbox, as a row and column range the Parquet scan can skip by; empty when they miss."""
    bounds = G.window_bounds(list(bbox), grid["gt"], grid["width"], grid["height"])
    if bounds is None:
        return cells.limit(0)
    r0, r1, c0, c1 = bounds
    return cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def mosaic(pieces: DataFrame, grid: dict) -> DataFrame:
    """Tiles of one layer as one grid.

    ``pieces`` carry their own upper-left corner in ``x0`` and ``y0``; rows and columns shift by
    the whole number of cells between that corner and the mosaic's.
    """
    gt = grid["gt"]
    dr = F.round((F.col("y0") - gt[3]) / gt[5]).cast("int")
    dc = F.round((F.col("x0") - gt[0]) / gt[1]).cast("int")
    return pieces.withColumn("row", F.col("row") + dr).withColumn("col", F.col("col") + dc).drop("x0", "y0")


def first_wins(pieces: DataFrame, order: str, value: str = "value") -> DataFrame:
    """Scenes in order; a later one fills only cells still zero or unknown."""
    return pieces.where(F.col(value) != 0).groupBy(*CELL).agg(F.min_by(value, order).alias(value))
