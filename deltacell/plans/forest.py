"""Forest masks on a target grid, from classes, from annual cover and loss, or from a ready mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell import schema as S
from deltacell.functions import radiometry as R
from deltacell.operators import focal
from deltacell.operators import masks as M
from deltacell.operators import resample

CELL = ["grid_id", "row", "col"]


def class_mask(classes: DataFrame, source: dict, target: dict, wanted: Sequence[int] = S.TREE_CLASSES, majority: int = 0) -> DataFrame:
    """Nearest class of each target cell, kept when wanted, optionally smoothed by majority."""
    near = resample.nearest(classes.select(*CELL, "cls"), source, target, value="cls")
    dense = near.withColumn("value", R.in_classes(F.col("cls"), wanted).cast("int")).drop("cls")
    return M.from_predicate(focal.majority_filter(dense, majority), F.col("value") == 1)


def annual_masks(
    classes: DataFrame, year: int, source: dict, target: dict, tau: int = S.COVER_TAU, fraction: float = S.FOREST_FRACTION
) -> tuple[DataFrame, DataFrame]:
    """Candidate and background masks for a storm year, by share of source cells."""
    flags = classes.select(
        *CELL, R.forest_candidate(F.col("cover"), F.col("loss"), year, tau).alias("candidate"),
        R.forest_background(F.col("cover"), F.col("loss"), year, tau).alias("background"),
    )
    return tuple(resample.fraction_mask(flags, source, target, f, fraction) for f in ("candidate", "background"))


def mask_file(mask: DataFrame, source: dict, target: dict) -> DataFrame:
    """A ready dense mask brought to the target grid; above zero is inside."""
    return M.from_predicate(resample.nearest(mask, source, target), F.col("value") > 0)


def backscatter_masks(composite: DataFrame, limits: Sequence[float] = (-18.0, -18.5, -19.0), majority: int = 3) -> DataFrame:
    """Forest stand-in from a cross-polarised composite: (limit, cells) with a majority filter."""
    out = None
    for limit in limits:
        dense = composite.withColumn("value", F.coalesce(F.col("value") > limit, F.lit(False)).cast("int"))
        m = M.from_predicate(focal.majority_filter(dense, majority), F.col("value") == 1).withColumn("limit", F.lit(float(limit)))
        out = m if out is None else out.unionByName(m)
    return out
