"""Whole detections. Each takes and returns tables keyed by ``grid_id``: many grids are one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell import schema as S
from deltacell.functions import naming as N
from deltacell.functions import radiometry as R
from deltacell.operators import align
from deltacell.operators import chains as C
from deltacell.operators import evaluate as E
from deltacell.operators import focal, objects, stack
from deltacell.session import settle

CELL = ["grid_id", "row", "col"]


@dataclass(frozen=True)
class Detection:
    index: DataFrame
    thresholds: DataFrame
    mask: DataFrame
    labelled: DataFrame
    objects: DataFrame
    run: DataFrame
    extras: dict[str, DataFrame] = field(default_factory=dict)


def posting_hint(grids: DataFrame, min_pixels: int) -> DataFrame:
    """Grids of fine cells whose smallest object would be far below the size the method was tested at.

    (grid_id, cell_m, min_object_ha, hint), one row for each grid it concerns.
    """
    # Cell size and object size below which the hint is given.
    fine_m, small_ha = 45.0, 2.0
    cell = F.abs(F.col("gt")[1])
    least = F.lit(min_pixels) * cell * F.abs(F.col("gt")[5]) / 1e4
    sized = grids.select("grid_id", cell.alias("cell_m"), least.alias("min_object_ha"))
    text = F.format_string("objects of %.2f ha are kept; at %.0f m cells ask for more cells an object", "min_object_ha", "cell_m")
    return sized.where((F.col("cell_m") < fine_m) & (F.col("min_object_ha") < small_ha)).withColumn("hint", text)


def on_grids(mask: DataFrame | None, own: DataFrame | None, grids: DataFrame | None) -> DataFrame | None:
    """A mask on the detection's grids; where its own grids are given, cells come from the nearest of them."""
    if mask is None or own is None or grids is None:
        return mask
    dense = mask.select(*CELL).distinct().withColumn("value", F.lit(1.0))
    return settle(align.onto(dense, own, grids, "nearest").where("value = 1").select(*CELL))


def _failed(grids: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds of all grids, with ``error`` for those whose sample holds no valid cell."""
    every = grids.select("grid_id").distinct().join(thresholds, "grid_id", "left")
    text = F.when(F.col("threshold").isNull() | F.isnan("threshold"), F.lit("no valid cells in the sample"))
    return settle(every.withColumn("error", text))


def reject_failed(run: DataFrame) -> DataFrame:
    """The same rows; reading a row of a failed grid is an error."""
    told = F.raise_error(F.concat(F.lit("grid "), F.col("grid_id"), F.lit(": "), F.col("error"))).cast("double")
    return run.withColumn("threshold", F.when(F.col("error").isNull(), F.col("threshold")).otherwise(told)).drop("error")


def _finish(
    index: DataFrame, thresholds: DataFrame, min_pixels: int, median_size: int, smooth_size: int,
    inside: DataFrame | None, cell_m2: float, min_area_ha: float | None, tile: int, extras: dict[str, DataFrame] | None = None,
    grids: DataFrame | None = None,
) -> Detection:
    usable = thresholds.where("error is null").drop("error")
    flagged = focal.threshold_map(index, usable, median_size, smooth_size, inside, tile=tile)
    labelled = settle(objects.remove_small(objects.components(flagged, tile), min_pixels))
    found = objects.object_stats(labelled, cell_m2)
    if grids is not None:
        found = settle(objects.measured(labelled, grids, min_pixels))
        extras = {**(extras or {}), "hints": posting_hint(grids, min_pixels)}
    if min_area_ha is not None:
        found = found.where(F.col("area_ha") >= min_area_ha)
    per_grid = found.groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("n_objects"), F.sum("n_px").alias("n_px"), F.sum("area_ha").alias("area_ha"),
        F.max("area_ha").alias("max_area_ha"),
    )
    run = thresholds.join(per_grid, "grid_id", "left").na.fill(0, ["n_objects", "n_px"]).na.fill(0.0, ["area_ha"])
    return Detection(index, thresholds, labelled.select(*CELL), labelled, found, run, extras or {})


def amplitude_index(
    obs: DataFrame, bands: Sequence[str], sign: float = 1.0, normalize: bool = False,
    background: DataFrame | None = None, analysis: DataFrame | None = None, power: int = 1,
) -> tuple[DataFrame, DataFrame | None]:
    """Signed sum of band changes per cell, written once, and the offsets removed from it (if any)."""
    used = obs.where(F.col("band").isin(*bands))
    cells = stack.deltas(stack.to_decibels(used, power=power), bands)
    offsets = None
    if normalize:
        cells = settle(cells)
        sample = background if background is not None else analysis
        offsets = settle(stack.band_offsets(cells, bands, sample))
        cells = stack.remove_offsets(cells, bands, offsets)
    return settle(stack.change_index(cells, bands, sign)), offsets


def detect_wi(
    obs: DataFrame, bands: Sequence[str] = ("VV", "VH"), *, mode: str = "adaptive", offset: float = S.AMPLITUDE_OFFSET_DB,
    fixed: float = S.AMPLITUDE_FIXED_DB, normalize: bool = False, analysis: DataFrame | None = None,
    background: DataFrame | None = None, median_size: int = S.MEDIAN_SIZE, smooth_size: int = 1,
    min_pixels: int = S.MIN_PIXELS_10M, cell_m2: float = 100.0, min_area_ha: float | None = None, sign: float = 1.0,
    power: int = 1, tile: int = focal.TILE, grids: DataFrame | None = None, mask_grids: DataFrame | None = None,
    built: tuple[DataFrame, DataFrame | None] | None = None,
) -> Detection:
    """Backscatter increase between two stacks of scenes.

    The threshold comes from the unfiltered index over the sample cells; it is applied to the
    filtered index. Grids must be dense, with NULL where there is no data. A grid whose sample has no
    valid cell detects nothing and says so in ``error`` of ``run``; the other grids go on.

    With ``grids`` (schema.GRID) areas are measured on the equal-area plane, and objects below
    ``min_pixels`` cells of area are left out; without, an object has ``cell_m2`` a cell.
    ``mask_grids`` describes masks that lie on grids of their own. ``built`` is what
    :func:`amplitude_index` returned for the same scenes and options, if that has been written before.
    """
    if mode not in ("adaptive", "fixed"):
        raise ValueError(f"unknown threshold mode: {mode}")
    analysis, background = on_grids(analysis, mask_grids, grids), on_grids(background, mask_grids, grids)
    index, offsets = built or amplitude_index(obs, bands, sign, normalize, background, analysis, power)
    if mode == "adaptive":
        thresholds = stack.mean_threshold(stack.statistics_sample(index, background, analysis), offset)
    else:
        thresholds = stack.fixed_threshold(index.where("value is not null"), fixed)
    extras = {"offsets": offsets} if offsets is not None else {}
    return _finish(
        index, _failed(index, thresholds), min_pixels, median_size, smooth_size, analysis, cell_m2, min_area_ha, tile, extras, grids
    )


def lband_bands(available: Sequence[str], wanted: Sequence[str] | None = None) -> tuple[list[str], bool]:
    """Bands to use and whether they are a stand-in. Asking for absent bands is an error."""
    asked = [b.upper() for b in wanted] if wanted is not None else ["HH", "HV"]
    if not asked:
        raise ValueError("at least one band is required")
    picked = [b for b in available if b.upper() in asked]
    if picked:
        return picked, False
    if wanted is not None:
        raise ValueError(f"none of {asked} among {list(available)}")
    return list(available), True


def detect_lband(obs: DataFrame, available: Sequence[str], wanted: Sequence[str] | None = None, offset: float = S.LBAND_OFFSET_DB, **options) -> Detection:
    """Backscatter decrease: the same detection with the sign turned."""
    bands, _ = lband_bands(available, wanted)
    return detect_wi(obs, bands, sign=-1.0, offset=offset, **options)


def detect_coherence(
    coherence: DataFrame, *, mode: str = "event_drop", has_control: bool = True, threshold_mode: str = "adaptive",
    offset: float = S.COHERENCE_OFFSET, fixed: float = S.COHERENCE_FIXED, analysis: DataFrame | None = None,
    background: DataFrame | None = None, water: DataFrame | None = None, nodata: float | None = None,
    median_size: int = S.MEDIAN_SIZE, smooth_size: int = 1, min_pixels: int = S.MIN_PIXELS_80M, cell_m2: float = 6400.0,
    min_area_ha: float | None = None, products: DataFrame | None = None, tile: int = focal.TILE,
    grids: DataFrame | None = None, control_grids: DataFrame | None = None, mask_grids: DataFrame | None = None, strict: bool = True,
) -> Detection:
    """Coherence change of a target pair against a control pair.

    ``grids`` (schema.GRID) describes the target pair's grids and gives areas as in :func:`detect_wi`.
    Where ``control_grids`` differ from them, the control pair is brought onto the target's grid by
    bilinear weights of valid cells, on the cells the target pair has; ``mask_grids`` does the same for
    masks, by nearest cells.

    ``products`` (grid_id, target, control paths) are checked first; a mismatch is an error.
    ``water`` (cells with value 1 on land, 0 on water) keeps land where it is believable and joins
    the analysis mask. Threshold and medians are taken over cells inside both masks. The safeguard
    looks at the analysis mask, else the background; the forest share is that of the background,
    else of the analysis mask. A grid without any valid cell in its sample is an error; with
    ``strict=False`` it only has ``error`` set in ``run``, and the other grids go on.
    """
    if threshold_mode not in ("adaptive", "fixed"):
        raise ValueError(f"unknown threshold mode: {threshold_mode}")
    extras = {}
    if control_grids is not None and has_control:
        if grids is None:
            raise ValueError("aligning a control pair needs the target's grids")
        control = coherence.where("role = 'control'").withColumn("value", R.sane_coherence(F.col("value"), nodata))
        coherence = coherence.where("role <> 'control'").select(*CELL, "role", "value")
        # A grid may be described larger than the pair's cells; what lies beyond them is no part of the scene and its edges.
        moved = settle(stack.within(align.onto(control.select(*CELL, "value"), control_grids, grids, "bilinear"), coherence))
        coherence = coherence.unionByName(moved.withColumn("role", F.lit("control")))
    analysis, background = on_grids(analysis, mask_grids, grids), on_grids(background, mask_grids, grids)
    if water is not None:
        analysis = settle(stack.both_masks(analysis, E.usable_land(water, ["grid_id"])))
    if products is not None:
        a, b = N.parse_product(F.col("target")), N.parse_product(F.col("control"))
        parsed = products.select("grid_id", a.alias("a"), b.alias("b"))
        issues = F.concat(C.pair_issues(F.col("a"), F.col("b")), C.temporal_issues(F.col("a"), F.col("b"), mode))
        extras["issues"] = settle(parsed.select("grid_id", C.reject_errors(issues).alias("issues")))
    layers = settle(stack.score_cells(stack.coherence_layers(coherence, nodata), mode, has_control))
    index = layers.select(*CELL, "value")
    masks = stack.both_masks(analysis, background)
    sample = layers.where("value is not null")
    sample = sample if masks is None else stack.within(sample, masks)
    if threshold_mode == "adaptive":
        thresholds = stack.median_threshold(sample, offset)
    else:
        thresholds = stack.fixed_threshold(sample, fixed)
    thresholds = _failed(layers, thresholds)
    missing = thresholds.where("error is not null").limit(5).collect() if strict else []
    if missing:
        raise ValueError(f"no valid cells inside the masks of {sorted(r[0] for r in missing)}")
    zone = analysis if analysis is not None else background
    name = "analysis" if analysis is not None else "background" if background is not None else "scene"
    share = None
    if zone is not None:
        forest = background if background is not None else analysis
        inside = forest.select(*CELL).distinct().withColumn("_in", F.lit(1))
        share = layers.join(inside, CELL, "left").groupBy("grid_id").agg(
            (F.count("_in") / F.count(F.lit(1))).alias("forest_share")
        )
    zoned = layers if zone is None else stack.within(layers, zone)
    extras["safeguard"] = E.safeguard(zoned, share, mode, name, has_control)
    extras["medians"] = E.layer_medians(sample)
    return _finish(
        index, thresholds, min_pixels, median_size, smooth_size, analysis, cell_m2, min_area_ha, tile, extras, grids
    )
