"""Evaluation runs over many events, variants, masks or indices at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltacell import schema as S
from deltacell.functions import radiometry as R
from deltacell.operators import evaluate as E
from deltacell.operators import focal
from deltacell.operators import masks as M
from deltacell.operators import objects, stack
from deltacell.operators.joins import attach, cell_join
from deltacell.plans.detect import Detection, amplitude_index, detect_wi
from deltacell.session import settle

CELL = ["grid_id", "row", "col"]


def reference_samples(cells: DataFrame, reference: DataFrame, ring: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Scores of reference cells (positive) and of ring cells that touch neither them nor other events."""
    bg = M.subtract(ring, reference) if others is None else M.subtract(ring, reference, others)
    marked = reference.select(*CELL).distinct().withColumn("positive", F.lit(True)).unionByName(
        bg.select(*CELL).distinct().withColumn("positive", F.lit(False))
    )
    return cell_join(cells, marked, CELL).where(F.col("value").isNotNull()).select(*CELL, F.col("value").alias("score"), "positive")


def pair_and_did(layers: DataFrame, reference: DataFrame, ring: DataFrame, others: DataFrame | None = None, did_rule: str = "both_positive") -> DataFrame:
    """One event's single pair and difference analysis: blocks, AUC, Youden, TPR at 5 % per method.

    Every grid (event) is a key, so a batch is one job.
    """
    t, c = F.col("target"), F.col("control")
    methods = F.array_compact(F.array(
        F.when(R.valid_coherence(t, c, "pair"), F.struct(F.lit("pair").alias("method"), (1 - t).alias("value"))),
        F.when(R.valid_coherence(t, c, did_rule), F.struct(F.lit("did").alias("method"), (c - t).alias("value"))),
    ))
    long = layers.select(*CELL, F.explode(methods).alias("_m")).select(*CELL, "_m.method", "_m.value")
    bg = M.subtract(ring, reference) if others is None else M.subtract(ring, reference, others)
    marked = reference.select(*CELL).distinct().withColumn("positive", F.lit(True)).unionByName(
        bg.select(*CELL).distinct().withColumn("positive", F.lit(False))
    )
    samples = settle(cell_join(long, marked, CELL).select(*CELL, "method", F.col("value").alias("score"), "positive"))
    keys = ["grid_id", "method"]
    curve = settle(E.score_curve(samples, keys))
    y = E.youden_quantile(curve, keys).select(
        *keys, F.col("threshold").alias("youden_thr"), F.col("tpr").alias("youden_tpr"), F.col("fpr").alias("youden_fpr")
    )
    five = E.tpr_at_fpr(samples, keys).select(*keys, F.col("tpr").alias("tpr_at_fpr5"))
    return E.class_medians(samples, keys).join(E.rank_auc(curve, keys).select(*keys, "auc"), keys).join(y, keys).join(five, keys)


def rescore(samples: DataFrame, variants: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Background variants per event and their mean AUC over events."""
    per_event = settle(E.background_sensitivity(samples, ["grid_id"], variants))
    return per_event, E.mean_auc(per_event, ["variant"])


def run_variants(
    obs: DataFrame, variants: Mapping[str, dict], reference: DataFrame, bands: Sequence[str] = ("VV", "VH"), tile: int = focal.TILE,
    **shared,
) -> DataFrame:
    """Detections that differ in scenes, threshold, normalisation or mask, with PA, UA and F1.

    A variant is a dict of ``detect_wi`` options plus ``scenes`` (a predicate on the observations).
    Variants with the same scenes and index options share one written index.
    """
    ref = settle(objects.components(reference, tile))
    built: dict[tuple, tuple] = {}
    out = None
    for name, options in variants.items():
        options = {**shared, **options}
        scenes = options.pop("scenes", None)
        used = obs if scenes is None else obs.where(scenes)
        normalize, analysis, background = options.get("normalize", False), options.get("analysis"), options.get("background")
        make = {"sign": options.get("sign", 1.0), "normalize": normalize, "power": options.get("power", 1)}
        key = (str(scenes), *make.values(), *((id(background), id(analysis)) if normalize else ()))
        if key not in built:
            built[key] = amplitude_index(used, bands, background=background, analysis=analysis, **make)
        d = detect_wi(used, bands, tile=tile, built=built[key], **options)
        m = E.object_metrics(ref, d.labelled).join(
            d.run.select("grid_id", "threshold", "n_objects", "area_ha"), "grid_id", "left"
        ).withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def mask_bits(masks: Sequence[DataFrame | None]) -> tuple[DataFrame | None, int]:
    """Cells of any mask with a bit for each mask they are in, and the bits of masks that are everywhere (None)."""
    given = [m.select(*CELL, F.lit(1 << k).cast("long").alias("bits")) for k, m in enumerate(masks) if m is not None]
    every = sum(1 << k for k, m in enumerate(masks) if m is None)
    cells = None
    for m in given:
        cells = m if cells is None else cells.union(m)
    return (None if cells is None else cells.groupBy(*CELL).agg(F.bit_or("bits").alias("bits"))), every


def mask_effect(index: DataFrame, masks: Mapping[str, DataFrame | None], reference: DataFrame, min_pixels: int = S.MIN_PIXELS_10M, offset: float = S.AMPLITUDE_OFFSET_DB, tile: int = focal.TILE) -> DataFrame:
    """One written index under several masks: statistics and cut change, composites do not.

    Masks are bits of a cell (at most 62 of them) and meet the index once, so one pass gives every mask's
    threshold, one pass of the filter serves all and carries the bits, and objects are labelled and scored
    with the pair (mask, grid) as their key.
    """
    names = list(masks)
    if len(names) > 62:
        raise ValueError("at most 62 masks")
    cells, every = mask_bits([masks[n] for n in names])
    plain = index.select(*CELL, "value")
    bare = plain.withColumn("bits", F.lit(0).cast("long")) if cells is None else cell_join(plain, cells, CELL, "left")
    marked = settle(bare.withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")).bitwiseOR(F.lit(every).cast("long"))))
    has = lambda k: F.getbit("bits", F.lit(k)) == 1
    means = marked.groupBy("grid_id").agg(*[F.avg(F.when(has(k), F.col("value"))).alias(f"_{k}") for k in range(len(names))])
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("center"), (F.col(f"_{k}") + offset).alias("threshold")) for k in range(len(names))])
    limits = settle(means.select("grid_id", F.filter(each, lambda e: e["center"].isNotNull()).alias("_cuts")))
    even = attach(focal.filtered(marked, S.MEDIAN_SIZE, 1, tile=tile, carry=["bits"]), limits, ["grid_id"], "inner")
    over = even.withColumn("_cuts", F.filter("_cuts", lambda e: F.coalesce(F.col("value") > e["threshold"], F.lit(False)))).where(F.size("_cuts") > 0)
    cut = over.withColumn("_e", F.explode("_cuts")).where(F.getbit("bits", F.col("_e.k")) == 1)
    run = lambda k: F.concat(k.cast("string"), F.lit("@"), F.col("grid_id")).alias("grid_id")
    flagged = cut.select(run(F.col("_e.k")), "row", "col", "value")
    det = settle(objects.remove_small(objects.components(flagged, tile), min_pixels))
    ref = settle(objects.components(reference, tile)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    found = E.object_metrics(ref.select(run(F.col("_k")), "row", "col", "label", "part"), det)
    number = F.substring_index("grid_id", "@", 1).cast("int")
    named = found.withColumn("_k", number).withColumn("grid_id", F.expr("substr(grid_id, instr(grid_id, '@') + 1)"))
    told = limits.select("grid_id", F.explode("_cuts").alias("_e")).select("grid_id", F.col("_e.k").alias("_k"), "_e.center", "_e.threshold")
    return named.join(told, ["grid_id", "_k"], "left").withColumn("mask", F.get(F.array(*map(F.lit, names)), F.col("_k"))).drop("_k")


def index_detections(family: DataFrame, reference: DataFrame, samples: DataFrame, offset: float = S.AMPLITUDE_OFFSET_DB, min_pixels: int = S.MIN_PIXELS_10M, tile: int = focal.TILE) -> DataFrame:
    """Each index of the family cut at its study-form and at its adaptive threshold, PA and UA each.

    The pair (grid, index, mode) becomes the grid key, so all detections run as one job.
    """
    keys = ["grid_id", "index"]
    curve = settle(E.score_curve(samples, keys))
    youden = E.youden_le(curve, keys).select(*keys, F.lit("youden").alias("mode"), "threshold")
    adaptive = samples.where(~F.col("positive")).groupBy(*keys).agg((F.avg("score") + offset).alias("threshold"))
    limits = settle(youden.unionByName(adaptive.select(*keys, F.lit("adaptive").alias("mode"), "threshold")))
    run = F.concat_ws("|", "grid_id", "index", "mode")
    modes = F.explode(F.array(F.lit("youden"), F.lit("adaptive")))
    runs = family.withColumn("mode", modes).select(run.alias("grid_id"), "row", "col", "value")
    per_run = limits.select(run.alias("grid_id"), "threshold")
    flagged = focal.threshold_map(runs, per_run, tile=tile)
    det = settle(objects.remove_small(objects.components(flagged, tile), min_pixels))
    ref_runs = reference.join(limits.select(*keys, "mode"), "grid_id").select(run.alias("grid_id"), "row", "col")
    ref = settle(objects.components(ref_runs, tile))
    named = limits.select(*keys, "mode", "threshold", run.alias("_run"))
    metrics = E.object_metrics(ref, det).withColumnRenamed("grid_id", "_run")
    return named.join(metrics, "_run", "left").drop("_run")


def study_samples(family: DataFrame, reference: DataFrame, background: DataFrame, stride: int = 1) -> DataFrame:
    """Samples of every index of the family; ``stride`` is the study's own sampling operator."""
    kept = family if stride <= 1 else stack.stride_sample(family, stride)
    marked = reference.select(*CELL).distinct().withColumn("positive", F.lit(True)).unionByName(
        M.subtract(background, reference).distinct().withColumn("positive", F.lit(False))
    )
    return cell_join(kept, marked, CELL).where(F.col("value").isNotNull()).select(
        *CELL, "index", F.col("value").alias("score"), "positive"
    )


def accuracy_row(d: Detection, reference: DataFrame, tile: int = focal.TILE) -> DataFrame:
    """PA, UA, F1 and volume of one detection per grid."""
    ref = objects.components(reference, tile)
    return E.object_metrics(ref, d.labelled).join(d.run, "grid_id", "left")
