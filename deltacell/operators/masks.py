"""Sparse masks: tables of the cells inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltacell.operators.joins import cell_join

CELL = ["grid_id", "row", "col"]


def keep_inside(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return cell_join(cells, mask.select(*CELL), CELL, "left_semi")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).intersect(b.select(*CELL))


def subtract(mask: DataFrame, *others: DataFrame) -> DataFrame:
    """Ring minus reference minus other events: one anti join against their union."""
    gone = others[0].select(*CELL)
    for o in others[1:]:
        gone = gone.unionByName(o.select(*CELL))
    return cell_join(mask.select(*CELL), gone, CELL, "left_anti")


def from_predicate(cells: DataFrame, keep: Column) -> DataFrame:
    return cells.where(F.coalesce(keep, F.lit(False))).select(*CELL)


def check_grid(mask: DataFrame, grids: DataFrame) -> DataFrame:
    """Mask cells with an error for any outside its grid's shape; ``grids`` has height and width."""
    from deltacell.operators.joins import attach

    placed = attach(mask.select(*CELL), grids.select("grid_id", "height", "width"), ["grid_id"])
    inside = F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)
    row = F.when(inside, F.col("row")).otherwise(F.raise_error(F.lit("mask cell outside its grid")).cast("int"))
    return placed.select("grid_id", row.alias("row"), "col")


def shares_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Grid ids described differently by two grid tables; empty means the masks may be combined."""
    from deltacell.functions.geometry import same_grid

    left = a.select("grid_id", F.struct("width", "height", "gt", "epsg").alias("_a"))
    right = b.select("grid_id", F.struct("width", "height", "gt", "epsg").alias("_b"))
    both = left.join(right, "grid_id", "full")
    return both.where(~F.coalesce(same_grid(F.col("_a"), F.col("_b")), F.lit(False))).select("grid_id")
