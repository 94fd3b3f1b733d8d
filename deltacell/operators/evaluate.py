"""Scoring a map against reference cells. Samples are rows (keys, score, positive)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltacell import schema as S
from deltacell.operators.joins import attach, cell_join
from deltacell.operators.order import quantiles, running
from deltacell.session import settle

SIZE_CLASSES = ((0.0, 2.0), (2.0, 5.0), (5.0, 10.0), (10.0, None))


def class_counts(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score: the map-side reduction behind every curve."""
    return (
        samples.where(F.col("score").isNotNull())
        .groupBy(*keys, "score")
        .agg(F.count_if(F.col("positive")).alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    )


def score_curve(samples: DataFrame, keys: Sequence[str], task_rows: int | None = None) -> DataFrame:
    extra = {} if task_rows is None else {"task_rows": task_rows}
    return running(class_counts(samples, keys), list(keys), "score", ["pos", "neg"], **extra)


def rank_auc(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chance that a positive scores higher than a negative, ties counted half. NULL if a class is empty."""
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2)
    pairs = F.max("pos_all").cast("double") * F.max("neg_all")
    return curve.groupBy(*keys).agg(
        F.max("pos_all").alias("n_pos"), F.max("neg_all").alias("n_neg"),
        F.try_divide(F.sum(wins), F.nullif(pairs, F.lit(0.0))).alias("auc"),
    )


def youden_le(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Study form: shares at or below each distinct value, first maximum of their difference."""
    tpr = F.try_divide(F.col("pos_before") + F.col("pos"), F.greatest(F.col("pos_all"), F.lit(1)))
    fpr = F.try_divide(F.col("neg_before") + F.col("neg"), F.greatest(F.col("neg_all"), F.lit(1)))
    return _best(curve.withColumn("tpr", tpr).withColumn("fpr", fpr), keys)


def _best(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    rank = F.struct((F.col("tpr") - F.col("fpr")).alias("j"), (-F.col("score")).alias("tie"))
    return points.groupBy(*keys).agg(
        F.max_by(F.struct("score", "tpr", "fpr"), rank).alias("_b")
    ).select(*keys, F.col("_b.score").alias("threshold"), F.col("_b.tpr").alias("tpr"), F.col("_b.fpr").alias("fpr"))


def youden_quantile(curve: DataFrame, keys: Sequence[str], n: int = 400, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """Best of ``n`` thresholds set at pooled quantiles; shares count scores at or above.

    Each curve row knows which pooled ranks it covers, so the thresholds come from the curve itself
    and only the ``n`` of them travel on.
    """
    total = F.col("pos_all") + F.col("neg_all")
    start = F.col("pos_before") + F.col("neg_before")
    stop = start + F.col("pos") + F.col("neg")
    at = lambda i: (lo + (hi - lo) * i / (n - 1)) * (total - 1)
    first = lambda i: F.floor(at(i))
    last = lambda i: F.ceil(at(i))
    # Thresholds whose rank can fall on this row, by arithmetic; the exact test follows.
    number = lambda rank: (rank / F.greatest(total - 1, F.lit(1)) - lo) / (hi - lo) * (n - 1)
    low = F.greatest(F.lit(0), F.floor(number(start - 1)).cast("int"))
    high = F.least(F.lit(n - 1), F.ceil(number(stop + 1)).cast("int"))
    rows = (
        curve.withColumn("_a", low).withColumn("_b", high).where(F.col("_a") <= F.col("_b"))
        .withColumn("_i", F.explode(F.sequence("_a", "_b")))
    )
    on = lambda r: (r >= start) & (r < stop)
    rows = rows.where(on(first(F.col("_i"))) | on(last(F.col("_i"))))
    i = F.col("_i")
    marks = rows.groupBy(*keys, "_i").agg(
        F.max(F.when((first(i) >= start) & (first(i) < stop), F.col("score"))).alias("_lo"),
        F.max(F.when((last(i) >= start) & (last(i) < stop), F.col("score"))).alias("_hi"),
        F.max(at(i) - F.floor(at(i))).alias("_f"),
        F.max("pos_all").alias("pos_all"), F.max("neg_all").alias("neg_all"),
        # Counts at or above the threshold: all rows from the upper neighbour on, plus the lower
        # neighbour itself when the threshold falls exactly on it.
        F.max(F.when((last(i) >= start) & (last(i) < stop), F.col("pos_before"))).alias("_pb"),
        F.max(F.when((last(i) >= start) & (last(i) < stop), F.col("neg_before"))).alias("_nb"),
        F.max(F.when((first(i) >= start) & (first(i) < stop), F.col("pos_before"))).alias("_pl"),
        F.max(F.when((first(i) >= start) & (first(i) < stop), F.col("neg_before"))).alias("_nl"),
    )
    score = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    on_lower = score == F.col("_lo")
    points = marks.select(
        *keys, score.alias("score"),
        F.try_divide(F.col("pos_all") - F.when(on_lower, F.col("_pl")).otherwise(F.col("_pb")), F.col("pos_all")).alias("tpr"),
        F.try_divide(F.col("neg_all") - F.when(on_lower, F.col("_nl")).otherwise(F.col("_nb")), F.col("neg_all")).alias("fpr"),
    )
    return _best(points, keys)


def share_at(samples: DataFrame, keys: Sequence[str], limits: DataFrame, limit: str, inclusive: bool) -> DataFrame:
    """True and false positive rate at each key's limit; ``inclusive`` counts equality as above."""
    joined = attach(samples, limits, list(keys), "inner").where(F.col("score").isNotNull())
    hit = (F.col("score") >= F.col(limit)) if inclusive else (F.col("score") > F.col(limit))
    rate = lambda side: F.avg(F.when(side, hit.cast("double")))
    return joined.groupBy(*keys).agg(
        F.max(limit).alias(limit), rate(F.col("positive")).alias("tpr"), rate(~F.col("positive")).alias("fpr")
    )


def tpr_at_fpr(samples: DataFrame, keys: Sequence[str], fpr: float = 0.05) -> DataFrame:
    """Research form: limit at the background's 1 - fpr quantile, scores at or above count."""
    limits = quantiles(samples.where(~F.col("positive")), list(keys), "score", {"threshold": 1.0 - fpr})
    return share_at(samples, keys, limits.select(*keys, "threshold"), "threshold", True)


def adaptive_point(samples: DataFrame, keys: Sequence[str], offset: float = S.AMPLITUDE_OFFSET_DB) -> DataFrame:
    """Rates strictly above mean background plus offset."""
    limits = samples.where(~F.col("positive")).groupBy(*keys).agg((F.avg("score") + offset).alias("threshold"))
    return share_at(samples, keys, limits, "threshold", False)


def class_medians(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and median per class, and the excess of the reference over the background."""
    long = quantiles(samples, [*keys, "positive"], "score", {"median": 0.5})
    pick = lambda side, c: F.max(F.when(side, F.col(c)))
    pos, neg = F.col("positive"), ~F.col("positive")
    return long.groupBy(*keys).agg(
        F.coalesce(pick(pos, "n"), F.lit(0)).alias("n_ref"), F.coalesce(pick(neg, "n"), F.lit(0)).alias("n_bg"),
        pick(pos, "median").alias("median_ref"), pick(neg, "median").alias("median_bg"),
    ).withColumn("excess", F.col("median_ref") - F.col("median_bg"))


def reference_evaluation(samples: DataFrame, keys: Sequence[str], fpr: float = 0.05, check_cells: bool = True) -> DataFrame:
    """Counts, AUC, medians, excess and the strict operating point, per key.

    With ``check_cells`` the samples carry ``row`` and ``col``, and a cell in both classes is an
    error. Fewer than two valid cells in a class is an error too.
    """
    if not 0 < fpr < 1:
        raise ValueError("fpr must lie between 0 and 1")
    keys = list(keys)
    samples = settle(samples)
    if check_cells:
        both = samples.groupBy(*keys, "row", "col").agg(F.count_distinct("positive").alias("c")).where("c > 1")
        if not both.isEmpty():
            raise ValueError("reference classes overlap")
    medians = class_medians(samples, keys)
    auc = rank_auc(score_curve(samples, keys), keys).select(*keys, "auc")
    limits = quantiles(samples.where(~F.col("positive")), keys, "score", {"threshold": 1.0 - fpr})
    point = share_at(samples, keys, limits.select(*keys, "threshold"), "threshold", False)
    out = medians.join(auc, keys, "left").join(point, keys, "left")
    enough = (F.col("n_ref") >= 2) & (F.col("n_bg") >= 2)
    guard = F.when(enough, F.col("n_ref")).otherwise(
        F.raise_error(F.lit("at least two valid cells per class are required")).cast("bigint")
    )
    return out.withColumn("n_ref", guard)


def block_stats(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, median, mean and quartiles per block of cells."""
    q = quantiles(df, list(keys), value, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return q.join(df.groupBy(*keys).agg(F.avg(value).alias("mean")), list(keys))


def band_stats(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )


def background_sensitivity(samples: DataFrame, keys: Sequence[str], variants: Mapping[str, Column]) -> DataFrame:
    """The same reference against several backgrounds: counts, AUC, excess, TPR per variant.

    ``variants`` maps a name to a predicate that a background row must satisfy; reference rows
    belong to every variant. A variant without background keeps its row with NULL metrics.
    """
    named = F.array_compact(F.array(*[
        F.when(F.col("positive") | F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in variants.items()
    ]))
    long = settle(samples.withColumn("variant", F.explode(named)))
    by = [*keys, "variant"]
    auc = rank_auc(score_curve(long, by), by).select(*by, "auc")
    return class_medians(long, by).join(auc, by, "left").join(
        tpr_at_fpr(long, by).select(*by, F.col("tpr").alias("tpr_at_fpr5")), by, "left"
    )


def mean_auc(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("n_events"))


def index_study(samples: DataFrame, keys: Sequence[str], min_count: int = 100) -> DataFrame:
    """Contrast, AUC, study-form threshold and adaptive point per key with enough samples."""
    keys = list(keys)
    samples = settle(samples.where(F.col("score").isNotNull()))
    medians = class_medians(samples, keys).where((F.col("n_ref") >= min_count) & (F.col("n_bg") >= min_count))
    curve = settle(score_curve(samples, keys))
    y = youden_le(curve, keys).select(
        *keys, F.col("threshold").alias("youden_thr"), F.col("tpr").alias("youden_tpr"), F.col("fpr").alias("youden_fpr")
    )
    a = adaptive_point(samples, keys).select(
        *keys, F.col("threshold").alias("adaptive_thr"), F.col("tpr").alias("adaptive_tpr"),
        F.col("fpr").alias("adaptive_fpr"),
    )
    return medians.join(rank_auc(curve, keys).select(*keys, "auc"), keys).join(y, keys).join(a, keys)


def share_above(df: DataFrame, keys: Sequence[str], limits: Mapping[str, Column | float], value: str = "value") -> DataFrame:
    """Share of known values strictly above each named limit."""
    v = F.col(value)
    cols = []
    for name, limit in limits.items():
        lim = limit if isinstance(limit, Column) else F.lit(float(limit))
        cols.append(F.avg(F.when(v.isNotNull(), (v > lim).cast("double"))).alias(name))
    return df.groupBy(*keys).agg(*cols)


def dark_ring(ring: DataFrame, keys: Sequence[str], value: str = "value", share: float = 0.40) -> DataFrame:
    """Ring cells below their ring's ``share`` quantile: the darkest part stands in for forest."""
    limit = quantiles(ring, list(keys), value, {"dark_limit": share}).select(*keys, "dark_limit")
    return attach(ring, limit, list(keys), "inner").where(F.col(value) < F.col("dark_limit"))


# -- objects ---------------------------------------------------------------------------------

def component_overlap(components: DataFrame, mask: DataFrame) -> DataFrame:
    """Size of each labelled component and how many of its cells lie in ``mask``.

    ``components`` has (grid_id, row, col, label, part); counting per part first keeps a huge
    component from meeting in one task.
    """
    cell = ["grid_id", "row", "col"]
    marked = cell_join(components, mask.select(*cell).distinct().withColumn("_in", F.lit(1)), cell, "left")
    parts = marked.groupBy("grid_id", "label", "part").agg(
        F.count(F.lit(1)).alias("n_px"), F.count("_in").alias("n_hit")
    )
    return parts.groupBy("grid_id", "label").agg(F.sum("n_px").alias("n_px"), F.sum("n_hit").alias("n_hit"))


def object_metrics(reference: DataFrame, detected: DataFrame, share: float = S.OVERLAP_SHARE) -> DataFrame:
    """Producer's and user's accuracy and F1 over labelled components, per grid."""
    ref = component_overlap(reference, detected)
    det = component_overlap(detected, reference)
    hit = (F.col("n_hit") >= share * F.col("n_px")).cast("int")
    a = ref.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_ref"), F.sum(hit).alias("tp_ref"))
    b = det.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_det"), F.sum(hit).alias("tp_det"))
    both = a.join(b, "grid_id", "full").select(
        "grid_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_ref", "n_det", "tp_ref", "tp_det")]
    )
    some = (F.col("n_ref") > 0) & (F.col("n_det") > 0)
    out = both.withColumn("pa", F.when(some, F.col("tp_ref") / F.col("n_ref")).otherwise(0.0)).withColumn(
        "ua", F.when(some, F.col("tp_det") / F.col("n_det")).otherwise(0.0)
    )
    total = F.col("pa") + F.col("ua")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("pa") * F.col("ua") / total).otherwise(0.0))


def hit_rate_by_size(reference: DataFrame, detected: DataFrame, cell_ha: float, share: float = S.OVERLAP_SHARE) -> DataFrame:
    """Share of reference components hit, per size class in hectares."""
    ref = component_overlap(reference, detected)
    ha = F.col("n_px") * cell_ha
    label = F.lit(None).cast("string")
    for lo, hi in SIZE_CLASSES:
        inside = (ha >= lo) if hi is None else (ha >= lo) & (ha < hi)
        label = F.when(inside, F.lit(f"{lo:g}-{'max' if hi is None else format(hi, 'g')} ha")).otherwise(label)
    hit = (F.col("n_hit") >= share * F.col("n_px")).cast("double")
    return ref.withColumn("size_class", label).groupBy("grid_id", "size_class").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("hit_rate")
    )


# -- masks and water ---------------------------------------------------------------------------

def water_fraction(water: DataFrame, keys: Sequence[str], water_value: int = 0) -> DataFrame:
    """Share of water and whether the mask is believable (not above half)."""
    share = F.avg((F.col("value") == water_value).cast("double"))
    return water.groupBy(*keys).agg(share.alias("water_fraction"), (share <= S.MAX_WATER_SHARE).alias("usable"))


def usable_land(water: DataFrame, keys: Sequence[str], land_value: int = 1, water_value: int = 0) -> DataFrame:
    """Land cells where the mask is believable; every cell where it is not."""
    judged = attach(water, water_fraction(water, keys, water_value), list(keys))
    return judged.where(~F.col("usable") | (F.col("value") == land_value)).drop("water_fraction", "usable")


def mask_coverage(cells: DataFrame, keys: Sequence[str], masks: Sequence[str], reference: str, cell_ha: float) -> DataFrame:
    """Share of the area, hectares and reference coverage of each boolean mask column, as rows."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col(m).alias("_on")) for m in masks]))
    rows = cells.select(*keys, F.col(reference).alias("_ref"), long.alias("_e")).select(*keys, "_ref", "_e.mask", "_e._on")
    on = F.col("_on")
    return rows.groupBy(*keys, "mask").agg(
        F.avg(on.cast("double")).alias("share"), (F.count_if(on) * cell_ha).alias("area_ha"),
        (F.count_if(on & F.col("_ref")) / F.greatest(F.lit(1), F.count_if(F.col("_ref")))).alias("ref_coverage"),
    )


def safeguard(
    layers: DataFrame, share: DataFrame | None, mode: str = "event_drop", zone: str = "scene", has_control: bool = True
) -> DataFrame:
    """Applicability check per grid: mean coherence of the zone before the event, and forest share.

    ``layers`` are the zone's cells with ``target`` and ``control``; ``share`` has (grid_id,
    forest_share). In ``persistent_gain`` only the control pair lies before the event, so its mean
    is taken. Flags are raised in ``event_drop`` only.
    """
    layer = "control" if mode == "persistent_gain" and has_control else "target"
    out = layers.groupBy("grid_id").agg(F.avg(layer).alias("coh_mean"))
    if share is not None:
        out = out.join(share.select("grid_id", "forest_share"), "grid_id", "left")
    else:
        out = out.withColumn("forest_share", F.lit(None).cast("double"))
    high = F.coalesce(F.col("coh_mean") > S.NONFOREST_COHERENCE, F.lit(False))
    bare = F.coalesce(F.col("forest_share") < S.MIN_FOREST_SHARE, F.lit(False))
    drop = F.lit(mode == "event_drop")
    reasons = F.array_compact(F.array(
        F.when(high & drop, F.lit("high_coherence")).when(high, F.lit("note_high_coherence")),
        F.when(bare & drop, F.lit("low_forest_share")),
    ))
    flagged = drop & (high | bare)
    return out.select(
        "grid_id", F.lit(zone).alias("zone"), F.round("coh_mean", 4).alias("coh_mean"),
        F.round("forest_share", 4).alias("forest_share"), flagged.alias("flagged"),
        F.when(flagged, F.array(F.lit(S.OUTSIDE_FOREST_FLAG))).otherwise(F.array().cast("array<string>")).alias("flags"),
        reasons.alias("reasons"),
    )


def layer_medians(layers: DataFrame) -> DataFrame:
    """Valid cells, target and control medians, and a warning when the change is near the floor."""
    named = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("v")) for n in ("target", "control", "value")])
    long = layers.select("grid_id", F.explode(named).alias("_e")).select("grid_id", "_e.layer", "_e.v")
    q = quantiles(long, ["grid_id", "layer"], "v", {"median": 0.5})
    pick = lambda n, c: F.max(F.when(F.col("layer") == n, F.col(c)))
    return q.groupBy("grid_id").agg(
        pick("value", "n").alias("n_valid"), pick("target", "median").alias("target_median"),
        pick("control", "median").alias("control_median"), pick("value", "median").alias("score_median"),
    ).withColumn("near_floor", F.abs("score_median") < 0.05)


def detected_area(mask: DataFrame, keys: Sequence[str], cell_m2: float) -> DataFrame:
    return mask.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_px"), (F.count(F.lit(1)) * cell_m2 / 1e4).alias("area_ha")
    )


def zone_medians(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Median per zone; also the diagnosis of one event's two pairs."""
    return quantiles(cells, list(keys), value, {"median": 0.5})


