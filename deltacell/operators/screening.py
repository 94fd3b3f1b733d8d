"""Filtering, scoring and picking study sites; profiles and comparisons of event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltacell.functions import dates as D
from deltacell.functions.scoring import score_terms, suitability
from deltacell.operators.order import quantiles

# Limits of the screening rules.
ERA_FROM = 2015
BASE_AREA_KM2 = 0.5
WARM_MONTHS = (5, 6, 7, 8, 9)
LEAST_WIDTH_M = 150
UPDATED_FROM = "2018-01-01"
UPDATED_AREA_HA = 500.0
UPDATED_AREA_DAY_HA = 300.0
UPDATED_TYPES = ("шквал", "смерч", "шторм")
TYPE_NAMES = {"шквал": "squall", "смерч": "tornado", "шторм": "storm", "снегопад": "snowfall"}
REGION_LIMIT = 15


def base_pool() -> Column:
    return (
        (F.col("year") >= ERA_FROM) & (F.col("area_km2") >= BASE_AREA_KM2)
        & F.col("certainty").isin("High", "Medium") & D.is_known(F.col("date_1"))
    )


def funnel_steps(processed: Sequence[int] = ()) -> dict[str, Column]:
    """Named predicates of the funnel, each on top of those before."""
    done = F.col("id").isin(*processed) if processed else F.lit(False)
    return {
        "base_pool": base_pool(),
        "warm": D.month_of(F.col("date_1")).isin(*WARM_MONTHS),
        "non_snow": F.lower("type") != "snowstorm",
        "not_processed": ~done,
        "width": F.col("mean_width_m") >= LEAST_WIDTH_M,
        "high": F.col("certainty") == "High",
    }


def candidates(events: DataFrame, processed: Sequence[int] = ()) -> DataFrame:
    for p in funnel_steps(processed).values():
        events = events.where(p)
    return events


def funnel_counts(events: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows left after each step, all in one pass: (step, n) in step order."""
    so_far, counts = F.lit(True), [F.count(F.lit(1)).alias("total")]
    for name, p in steps.items():
        so_far = so_far & F.coalesce(p, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    names = ["total", *steps]
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(n).alias("n")) for i, n in enumerate(names)])
    return events.agg(*counts).select(F.explode(rows).alias("_r")).select("_r.*")


def updated_candidates(events: DataFrame, day_precision: bool = False) -> DataFrame:
    """Newer database: from 2018, three storm types, area limit by date precision."""
    pool = events.where((F.col("date") >= F.lit(UPDATED_FROM).cast("date")) & F.col("type").isin(*UPDATED_TYPES))
    if day_precision:
        return pool.where((F.col("area_ha") >= UPDATED_AREA_DAY_HA) & (F.col("date_unit") == "D"))
    return pool.where(F.col("area_ha") >= UPDATED_AREA_HA)


def names_any(text: Column, names: Sequence[str]) -> Column:
    """Does the text contain one of the names?"""
    return F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(text, n))


def translate(value: Column, names: Mapping[str, str] = TYPE_NAMES) -> Column:
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.create_map(*pairs)[value]


def scored(sites: DataFrame) -> DataFrame:
    """Add ``score`` and ``parts`` to candidate rows joined with chain quality and landscape."""
    total, parts = suitability(
        score_terms(*[F.col(c) for c in (
            "area_km2", "mean_width_m", "wind_gust", "type", "quality", "forest_frac", "water_frac", "slope_mean_deg"
        )])
    )
    return sites.withColumn("score", total).withColumn("parts", parts)


def _ranked(df: DataFrame, by: str, score: str, tie: str, n: int) -> DataFrame:
    """Best ``n`` per group; rank limits this small are applied before rows are shuffled."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def diverse_top(df: DataFrame, n: int = 5, per_type: int = 3, score: str = "score", tie: str = "id") -> DataFrame:
    """Best ``n`` with at most ``per_type`` of one type: the greedy pick, as two rank limits."""
    return _ranked(df, "type", score, tie, per_type).orderBy(F.desc(score), F.asc(tie)).limit(n)


def cohort(df: DataFrame, wanted: Mapping[str, int] | None = None, years: tuple[int, int] = (2015, 2017), check: bool = True) -> DataFrame:
    """Fixed number of best sites per type among full chains of the given years."""
    wanted = {"tornado": 3, "squall": 2} if wanted is None else dict(wanted)
    pool = df.where((F.col("quality") == "full") & F.col("year").between(*years) & F.col("type").isin(*wanted))
    limit = F.create_map(*[F.lit(v) for kv in wanted.items() for v in kv])[F.col("type")]
    w = Window.partitionBy("type").orderBy(F.desc("score"), F.asc("id"))
    ranked = pool.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(wanted.values()))
    picked = ranked.where(F.col("_k") <= limit).drop("_k")
    if check:
        have = {r[0]: r[1] for r in picked.groupBy("type").count().collect()}
        if any(have.get(t, 0) < n for t, n in wanted.items()):
            raise ValueError(f"cohort incomplete: {have}")
    return picked


def planned_jobs(sites: DataFrame, cost: int = 10) -> DataFrame:
    """Two jobs per site with their granules: pre and post, post and control."""
    job = lambda kind, a, b: F.struct(
        F.concat(F.lit("id"), F.col("id").cast("string"), F.lit("-coh-" + kind)).alias("name"),
        F.array(F.col(a), F.col(b)).alias("granules"), F.lit(cost).alias("credits"),
    )
    rows = F.array(job("prepost", "pre", "post"), job("control", "post", "control"))
    return sites.select("id", F.explode(rows).alias("_j")).select("id", "_j.*")


def landscape(cells: DataFrame, trees: Sequence[int] = (10, 95)) -> DataFrame:
    """Class fractions per event and its four most frequent classes. ``cells``: event_id, cls."""
    tally = cells.groupBy("event_id", "cls").agg(F.count(F.lit(1)).alias("n"))
    share = lambda cond: F.round(F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n"), 3)
    cls = F.col("cls")
    fractions = tally.groupBy("event_id").agg(
        share(cls.isin(*trees)).alias("forest_frac"), share(cls == 80).alias("water_frac"),
        share(cls == 90).alias("wetland_frac"), share(cls == 40).alias("crop_frac"),
        F.slice(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "cls", "n"))), lambda s: F.struct(s["cls"].alias("cls"), s["n"].alias("n"))
        ), 1, 4).alias("classes_top"),
    )
    return fractions


def forest_statistics(cells: DataFrame, taus: Sequence[int] = (20, 30, 50), main: int = 30) -> DataFrame:
    """Forest shares per event inside its polygon and ring, at several cover limits.

    ``cells``: event_id, year, zone ('poly' or 'ring'), cover, loss.
    """
    from deltacell.functions import radiometry as R

    cover, loss, year = F.col("cover"), F.col("loss"), F.col("year")
    poly = F.col("zone") == "poly"
    share = lambda zone, cond: F.round(F.avg(F.when(zone, cond.cast("double"))), 4)
    cols = [
        share(poly, R.forest_candidate(cover, loss, year, main)).alias("forest_cand_frac"),
        share(poly, R.forest_background(cover, loss, year, main)).alias("forest_bg_frac"),
        share(poly, R.loss_in_year(cover, loss, year, main)).alias("loss_in_year_frac"),
        share(~poly, R.forest_candidate(cover, loss, year, main)).alias("ring_forest_cand_frac"),
    ]
    cols += [share(poly, R.forest_candidate(cover, loss, year, t)).alias(f"forest_cand_frac_tau{t}") for t in taus]
    out = cells.groupBy("event_id").agg(*cols)
    cover_median = quantiles(cells.where(poly), ["event_id"], "cover", {"cover_median": 0.5}).select("event_id", "cover_median")
    return out.join(cover_median, "event_id", "left").withColumn("outside_forest", F.col("forest_cand_frac") < 0.30)


# -- event tables --------------------------------------------------------------------------------

def crosstab(df: DataFrame, row: Column, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts of ``column`` values per ``row``; naming the values saves the pass that finds them."""
    grouped = df.withColumn("_r", row).groupBy(F.col("_r").alias("key"))
    return grouped.pivot(column, list(values) if values else None).agg(F.count(F.lit(1))).na.fill(0)


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for each named column."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(long.alias("_e")).select("_e.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, distinct values and numeric range per column, in one pass over the table."""
    long = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(c).try_cast("double").alias("num"))
        for c in columns
    ]))
    rows = df.select(long.alias("_e")).select("_e.*")
    # Distinct values first, so that a frequent value is one row when counts meet.
    per_value = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"), F.max("num").alias("num"))
    return per_value.groupBy("column").agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"), F.min("num").alias("min"), F.max("num").alias("max"),
    )


def region_top(events: DataFrame, n: int = REGION_LIMIT) -> DataFrame:
    """Regions by summed area: the report's top list."""
    return events.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area")).orderBy(
        F.desc("area"), "region"
    ).limit(n)


def era_totals(events: DataFrame, by: Sequence[str], since: int = ERA_FROM) -> DataFrame:
    """Count and positive area per (attribute, value) of events since a year."""
    era = events.where(F.col("year") >= since)
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in by]))
    return era.select(long.alias("_e"), "area_km2").select("_e.*", "area_km2").groupBy("attribute", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("area_km2") > 0, F.col("area_km2"))).alias("area_km2")
    )


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, standard deviation, quartiles and range of a column."""
    q = quantiles(df, list(keys), value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.mean(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.sum(v).alias("total"),
    ).join(q, list(keys))


def found_and_missing(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each wanted id with whether the table has it."""
    have = table.select(key).distinct().withColumn("found", F.lit(True))
    return wanted.select(key).join(have, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids in one list only, with the side; no row means the lists agree."""
    left, right = a.select(key), b.select(key)
    only_a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def compare_attributes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new record side by side: date shift, area ratio, whether type and date agree.

    Both sides: key, type, date, area_km2.
    """
    a = old.select(key, *[F.col(c).alias(f"old_{c}") for c in ("type", "date", "area_km2")])
    b = new.select(key, *[F.col(c).alias(f"new_{c}") for c in ("type", "date", "area_km2")])
    return (
        a.join(b, key, "left")
        .withColumn("date_shift_days", F.abs(F.datediff("new_date", "old_date")))
        .withColumn("area_ratio", F.try_divide(F.col("new_area_km2"), F.nullif(F.col("old_area_km2"), F.lit(0.0))))
        .withColumn("same_type", F.col("old_type") == F.coalesce(translate(F.col("new_type")), F.col("new_type")))
        .withColumn("same_date", F.col("old_date") == F.col("new_date"))
    )


def priority_list(events: DataFrame, names: Sequence[str], n: int = 40) -> DataFrame:
    """Shortlist: named regions first, then area."""
    return events.withColumn("priority", names_any(F.col("region"), names)).orderBy(
        F.desc("priority"), F.desc("area"), "id"
    ).limit(n)


def largest(df: DataFrame, n: int, by: str = "area", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def is_truncated(df: DataFrame, n: int) -> bool:
    """Does the result hold more rows than the limit? Reads at most one row past it."""
    return df.limit(n + 1).count() > n


def width_gap_percent(excluding: Column, including: Column) -> Column:
    return F.when((excluding != 0) & (including > 0), (1 - excluding / including) * 100)
