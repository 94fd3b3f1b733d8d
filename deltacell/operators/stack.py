"""From stacks of scenes to an index per cell, and the statistics a threshold needs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltacell import schema as S
from deltacell.functions import radiometry as R
from deltacell.operators.joins import attach, cell_join
from deltacell.operators.order import quantiles

CELL = ["grid_id", "row", "col"]


def scale_flags(obs: DataFrame, keys: Sequence[str] = ("grid_id", "scene_id", "band")) -> DataFrame:
    """One row per scene and band: does it already hold decibels?"""
    return obs.groupBy(*keys).agg(R.is_db(F.col("value")).alias("already_db"))


def to_decibels(obs: DataFrame, keys: Sequence[str] = ("grid_id", "scene_id", "band"), power: int = 1) -> DataFrame:
    """Add ``db``. The scale is decided once per scene and band, so it cannot depend on chunking.

    Only scenes that hold decibels are looked up; where there are none, Spark drops the join as it runs.
    """
    flagged = attach(obs, scale_flags(obs, keys).where("already_db"), list(keys))
    already = F.coalesce("already_db", F.lit(False))
    return flagged.withColumn("db", R.to_db_domain(F.col("value"), already, power)).drop("already_db")


def _middle(obs: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The one or two middle known values of each group as ``_mid``; their mean is the median.

    Sorting within groups spills to disk, where an aggregate that holds every value would not. The
    first row of a group is kept with a NULL, so a group without known values does not vanish. Both
    windows share one order, so Spark reads a group once for both.
    """
    ordered = Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last())
    n = F.count(value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = obs.withColumn("_k", F.row_number().over(ordered)).withColumn("_n", n)
    middle = (2 * F.col("_k") >= F.col("_n")) & (2 * F.col("_k") <= F.col("_n") + 2) & (F.col("_n") > 0)
    kept = ranked.withColumn("_mid", F.when(middle, F.col(value))).where(middle | (F.col("_k") == 1))
    return kept.drop("_k", "_n")


def median_composite(obs: DataFrame, value: str = "db", keys: Sequence[str] = ("grid_id", "period", "band", "row", "col")) -> DataFrame:
    """Median over the scenes of a cell, NULLs ignored; the grouping reuses the window's layout."""
    laid = obs.select(*keys, value).repartition(*keys)
    return _middle(laid, keys, value).groupBy(*keys).agg(F.avg("_mid").alias("value"))


def common_bands(obs: DataFrame) -> DataFrame:
    """Bands present in both periods of a grid, VV and VH first, then by name."""
    first = F.array_position(F.array(F.lit("VV"), F.lit("VH")), F.col("band"))
    seen = obs.where(F.col("band") != "").groupBy("grid_id", "band").agg(F.collect_set("period").alias("_p"))
    both = seen.where(F.array_contains("_p", "pre") & F.array_contains("_p", "post"))
    order = F.struct(F.when(first == 0, 99).otherwise(first).alias("o"), F.col("band").alias("band"))
    return both.groupBy("grid_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["band"]).alias("bands"))


def deltas(obs: DataFrame, bands: Sequence[str], value: str = "db") -> DataFrame:
    """Post minus pre composite per cell, one column ``d_<band>`` each, in a single shuffle.

    Observations move once, to their cell. The medians per period and band and the pivot into
    columns both run on that layout, instead of one shuffle per period and band plus a join.
    """
    sides = [(p, b) for b in bands for p in ("pre", "post")]
    number = F.coalesce(*[F.when((F.col("period") == p) & (F.col("band") == b), F.lit(i)) for i, (p, b) in enumerate(sides)])
    wanted = obs.where(F.col("band").isin(*bands) & F.col("period").isin("pre", "post"))
    laid = wanted.select(*CELL, number.alias("_side"), value).repartition(*CELL)
    aggs = [F.avg(F.when(F.col("_side") == i, F.col("_mid"))).alias(f"_{p}_{b}") for i, (p, b) in enumerate(sides)]
    cells = _middle(laid, [*CELL, "_side"], value).groupBy(*CELL).agg(*aggs)
    return cells.select(*CELL, *[(F.col(f"_post_{b}") - F.col(f"_pre_{b}")).alias(f"d_{b}") for b in bands])


def band_offsets(cells: DataFrame, bands: Sequence[str], sample: DataFrame | None = None) -> DataFrame:
    """Median delta of each band over the sample cells, 0 for an empty sample, per grid."""
    used = cells if sample is None else within(cells, sample)
    named = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"d_{b}").alias("d")) for b in bands])
    long = used.select("grid_id", F.explode(named).alias("_e")).select("grid_id", "_e.band", "_e.d")
    per_band = quantiles(long, ["grid_id", "band"], "d", {"offset": 0.5})
    found = per_band.groupBy("grid_id").agg(
        *[F.max(F.when(F.col("band") == b, F.col("offset"))).alias(f"o_{b}") for b in bands]
    )
    grids = cells.select("grid_id").distinct()
    return grids.join(found, "grid_id", "left").select(
        "grid_id", *[F.coalesce(f"o_{b}", F.lit(0.0)).alias(f"o_{b}") for b in bands]
    )


def remove_offsets(cells: DataFrame, bands: Sequence[str], offsets: DataFrame) -> DataFrame:
    joined = attach(cells, offsets, ["grid_id"])
    return joined.select(*CELL, *[(F.col(f"d_{b}") - F.col(f"o_{b}")).alias(f"d_{b}") for b in bands])


def weighted_index(weights: Mapping[str, float]) -> Column:
    """Weighted sum of band deltas; NULL in any used band gives NULL."""
    if not weights:
        raise ValueError("an index needs at least one band")
    total = None
    for band, w in weights.items():
        term = F.col(f"d_{band}") * float(w)
        total = term if total is None else total + term
    return total


def change_index(cells: DataFrame, bands: Sequence[str], sign: float = 1.0) -> DataFrame:
    return cells.select(*CELL, weighted_index({b: sign for b in bands}).alias("value"))


def index_family(cells: DataFrame, weights: Mapping[str, tuple[float, float]] = S.INDEX_WEIGHTS) -> DataFrame:
    """All studied indices of a cell as rows (``index``, ``value``), from the VV and VH deltas."""
    each = F.array(*[
        F.struct(F.lit(n).alias("index"), (F.col("d_VV") * vv + F.col("d_VH") * vh).alias("value"))
        for n, (vv, vh) in weights.items()
    ])
    return cells.select(*CELL, F.explode(each).alias("_e")).select(*CELL, "_e.index", "_e.value")


def within(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells inside a sparse mask."""
    return cell_join(cells, mask.select(*CELL).distinct(), CELL, "left_semi")


def both_masks(*masks: DataFrame | None) -> DataFrame | None:
    """Cells of every mask given; no mask at all means no restriction."""
    given = [m for m in masks if m is not None]
    out = given[0].select(*CELL).distinct() if given else None
    for m in given[1:]:
        out = within(out, m)
    return out


def statistics_sample(cells: DataFrame, background: DataFrame | None = None, analysis: DataFrame | None = None) -> DataFrame:
    """Background mask first, then the analysis mask, then the whole grid."""
    chosen = background if background is not None else analysis
    return cells if chosen is None else within(cells, chosen)


def mean_threshold(sample: DataFrame, offset: float = S.AMPLITUDE_OFFSET_DB) -> DataFrame:
    return sample.groupBy("grid_id").agg(F.avg("value").alias("center"), (F.avg("value") + offset).alias("threshold"))


def median_threshold(sample: DataFrame, offset: float = S.COHERENCE_OFFSET) -> DataFrame:
    return quantiles(sample, ["grid_id"], "value", {"center": 0.5}).select(
        "grid_id", "center", (F.col("center") + offset).alias("threshold")
    )


def fixed_threshold(cells: DataFrame, value: float) -> DataFrame:
    return cells.select("grid_id").distinct().withColumn("center", F.lit(None).cast("double")).withColumn(
        "threshold", F.lit(float(value))
    )


def flag_above(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cells strictly above their grid's threshold."""
    return attach(cells, thresholds, ["grid_id"]).where(R.above(F.col("value"), F.col("threshold")))


def coherence_layers(coherence: DataFrame, nodata: float | None = None) -> DataFrame:
    """Target and control side by side per cell; one grouping instead of a self join."""
    clean = coherence.withColumn("value", R.sane_coherence(F.col("value"), nodata))
    side = lambda r: F.max(F.when(F.col("role") == r, F.col("value"))).alias(r)
    return clean.groupBy(*CELL).agg(side("target"), side("control"))


def score_cells(layers: DataFrame, mode: str = "event_drop", has_control: bool = True) -> DataFrame:
    control = F.col("control") if has_control else None
    return layers.withColumn("value", R.coherence_score(F.col("target"), control, mode))


def stride_sample(cells: DataFrame, stride: int) -> DataFrame:
    """Every stride-th row and column: the study's own sampling operator."""
    return cells.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
