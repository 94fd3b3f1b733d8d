"""Chaining acquisitions around an event date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltacell.operators.joins import salted_join

# Day ranges and coverage limits of a usable chain.
STEP_DAYS = (10, 27)
FULL_STEP_DAYS = 14
FULL_COVERAGE = 0.95
LEAST_COVERAGE = 0.85
WINDOW_DAYS = (16, 42)
LABELS = ("pre3", "pre2", "pre1", "base")


def _triples(days: DataFrame, keys: list[str], day: str, carried: list[str]) -> DataFrame:
    """Each day with the next two of its chain; later ones carry the suffixes 2 and 3.

    The window runs over distinct days of one track, so its length is bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    out = days
    for c in [day, *carried]:
        out = out.withColumn(f"{c}2", F.lead(c, 1).over(w)).withColumn(f"{c}3", F.lead(c, 2).over(w))
    return out.where(F.col(f"{day}3").isNotNull())


def exact_triples(acquisitions: DataFrame, events: DataFrame, step: int = 12) -> DataFrame:
    """Three acquisitions of one track ``step`` days apart with the event strictly between the first two.

    ``acquisitions``: platform, orbit_key, ts, title. ``events``: event_id, event_date. Steps are
    whole days between dates. Events meet only the triples whose first day can precede them, one
    join row per day of the step.
    """
    days = acquisitions.groupBy("platform", "orbit_key", F.to_date("ts").alias("d")).agg(
        F.max("title").alias("g"), F.hour(F.min("ts")).alias("pass_hour")
    )
    runs = _triples(days, ["platform", "orbit_key"], "d", ["g"]).where(
        (F.datediff("d2", "d") == step) & (F.datediff("d3", "d2") == step)
    )
    open_days = runs.withColumn("event_date", F.explode(F.sequence(F.date_add("d", 1), F.date_sub("d2", 1))))
    met = salted_join(open_days, events.select("event_id", "event_date"), ["event_date"], "inner")
    gap = F.greatest(F.datediff("event_date", "d"), F.datediff("d2", "event_date"))
    return met.select(
        "event_id", "event_date", "platform", "orbit_key", F.col("d").alias("d1"), "d2", "d3",
        F.col("g").alias("g1"), "g2", "g3", "pass_hour", gap.alias("gap_days"),
    )


def chain_quality(d1: Column, d2: Column, coverage: Column) -> Column:
    base = F.when((d1 <= FULL_STEP_DAYS) & (d2 <= FULL_STEP_DAYS), "full").otherwise("stretched")
    return F.when(coverage >= FULL_COVERAGE, base).when(coverage >= LEAST_COVERAGE, "partial").otherwise("none")


def select_chains(acquisitions: DataFrame, events: DataFrame) -> DataFrame:
    """Best pre/post/control chain per event.

    ``acquisitions``: event_id, platform, mode, orbit_key, ts, cov, title (already those of the
    event's window). ``events``: event_id, event_date. Per date the granule with most coverage
    stands for the pass; steps count whole days of elapsed time; pre < event <= post. A ``direction``
    column, if there, is kept as the chain's first known one.
    """
    known = F.col("direction") if "direction" in acquisitions.columns else F.lit(None).cast("string")
    track = ["event_id", "platform", "mode", "orbit_key"]
    day = F.to_date("ts")
    # Most coverage first, then the earlier pass: an aggregate, so no day's granules are gathered.
    best = F.max_by(F.struct("ts", "cov", "title", known.alias("direction")), F.struct("cov", (-F.unix_micros("ts")).alias("_t")))
    daily = acquisitions.where(F.col("mode") == "IW").groupBy(*track, day.alias("d")).agg(best.alias("_b"))
    daily = daily.select(*track, F.col("_b.ts").alias("ts"), F.col("_b.cov").alias("cov"), F.col("_b.direction").alias("direction"))
    runs = _triples(daily, track, "ts", ["cov", "direction"])
    elapsed = lambda a, b: F.floor((F.unix_micros(b) - F.unix_micros(a)) / 86_400_000_000).cast("int")
    s1, s2 = elapsed("ts", "ts2"), elapsed("ts2", "ts3")
    cov = F.least("cov", "cov2", "cov3")
    fit = (
        runs.join(events.select("event_id", "event_date"), "event_id")
        .withColumn("pair_interval_days", s1).withColumn("control_interval_days", s2)
        .where(F.col("pair_interval_days").between(*STEP_DAYS) & F.col("control_interval_days").between(*STEP_DAYS))
        .where((F.col("ts") < F.col("event_date").cast("timestamp")) & (F.col("event_date").cast("timestamp") <= F.col("ts2")))
        .withColumn("gap_days_pre", elapsed("ts", F.col("event_date").cast("timestamp")))
        .withColumn("gap_days_post", elapsed(F.col("event_date").cast("timestamp"), "ts2"))
        .withColumn("min_coverage", cov)
        .withColumn("quality", chain_quality(F.col("pair_interval_days"), F.col("control_interval_days"), F.col("min_coverage")))
        .where(F.col("quality") != "none")
    )
    level = F.when(F.col("quality") == "full", 3).when(F.col("quality") == "stretched", 2).otherwise(1)
    order = F.struct(
        level.alias("q"), "min_coverage", (-F.unix_micros("ts")).alias("a"), F.col("platform").alias("b"),
        F.col("orbit_key").alias("c"),
    )
    kept = F.struct(
        "platform", F.coalesce("direction", "direction2", "direction3").alias("direction"), F.col("orbit_key").alias("rel_orbit"), F.to_date("ts").alias("pre"), F.to_date("ts2").alias("post"),
        F.to_date("ts3").alias("control"), "pair_interval_days", "control_interval_days", "min_coverage",
        F.array("cov", "cov2", "cov3").alias("coverages"), "quality", "gap_days_pre", "gap_days_post",
    )
    return fit.groupBy("event_id", "event_date").agg(F.max_by(kept, order).alias("_k")).select(
        "event_id", "event_date", "_k.*"
    )


def scene_plan(scenes: DataFrame, events: DataFrame) -> DataFrame:
    """Labelled scenes of the best orbit group per event: pre3 pre2 pre1 base, post, post2.

    ``scenes``: event_id, orbit_key, scene_id, ts. ``events``: event_id, pre_from, pre_to,
    post_from, post_to, min_pre. Fewer than four pre scenes keep the last labels.
    """
    d = F.to_date("ts")
    joined = scenes.join(events, "event_id")
    side = F.when(d.between(F.col("pre_from"), F.col("pre_to")), "pre").when(
        d.between(F.col("post_from"), F.col("post_to")), "post"
    )
    sided = joined.withColumn("_side", side)
    group = ["event_id", "orbit_key"]
    sizes = sided.groupBy(*group, "min_pre").agg(
        F.count_if(F.col("_side") == "pre").alias("n_pre"), F.count_if(F.col("_side") == "post").alias("n_post"),
        F.count(F.lit(1)).alias("n"),
    ).where((F.col("n_post") >= 1) & (F.col("n_pre") >= F.col("min_pre")))
    order = F.struct(
        (F.col("n_post") >= 2).alias("a"), F.least("n_pre", F.lit(4)).alias("b"), F.col("n_post").alias("c"),
        F.col("n").alias("e"), F.col("orbit_key").alias("f"),
    )
    chosen = sizes.groupBy("event_id").agg(F.max_by("orbit_key", order).alias("orbit_key"))
    used = sided.where("_side is not null").join(chosen, group, "left_semi")
    back = Window.partitionBy("event_id", "_side").orderBy(F.desc("ts"), F.desc("scene_id"))
    ahead = Window.partitionBy("event_id", "_side").orderBy("ts", "scene_id")
    pre = used.where("_side = 'pre'").withColumn("_k", F.row_number().over(back)).where("_k <= 4")
    post = used.where("_side = 'post'").withColumn("_k", F.row_number().over(ahead)).where("_k <= 2")
    pre = pre.withColumn("label", F.get(F.array(*map(F.lit, LABELS)), 4 - F.col("_k")))
    post = post.withColumn("label", F.when(F.col("_k") == 1, "post").otherwise("post2"))
    return pre.unionByName(post).select("event_id", "orbit_key", "label", "scene_id", "ts")


def interferometric_pairs(dates: DataFrame, keys: list[str]) -> DataFrame:
    """Up to three pairs per key around ``event_date``: straddling, before, after, with their days.

    ``dates``: keys, event_date, d. The two latest days before and the two earliest after are
    bounded aggregates, so a busy track costs no more than a quiet one.
    """
    before = F.max(F.when(F.col("d") < F.col("event_date"), F.col("d")))
    after = F.min(F.when(F.col("d") > F.col("event_date"), F.col("d")))
    near = dates.groupBy(*keys, "event_date").agg(before.alias("b1"), after.alias("a1"))
    second = dates.join(near, [*keys, "event_date"]).groupBy(*keys, "event_date", "b1", "a1").agg(
        F.max(F.when(F.col("d") < F.col("b1"), F.col("d"))).alias("b2"),
        F.min(F.when(F.col("d") > F.col("a1"), F.col("d"))).alias("a2"),
    )
    pair = lambda kind, ref, sec: F.struct(F.lit(kind).alias("kind"), F.col(ref).alias("ref"), F.col(sec).alias("sec"))
    rows = F.array(
        pair("primary_straddling_event", "b1", "a1"), pair("control_pre_pre", "b2", "b1"),
        pair("control_post_post", "a1", "a2"),
    )
    return (
        second.select(*keys, "event_date", F.explode(rows).alias("_p")).select(*keys, "event_date", "_p.*")
        .where(F.col("ref").isNotNull() & F.col("sec").isNotNull())
        .withColumn("baseline_days", F.datediff("sec", "ref"))
    )


def nearest_scene(scenes: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Scene nearest to noon of each wanted date, from the day before to the day after.

    ``scenes``: keys, scene_id, ts. ``wanted``: keys, date. Scenes meet a date by their day.
    """
    near = wanted.withColumn("_d", F.explode(F.sequence(F.date_sub("date", 1), F.date_add("date", 1))))
    met = scenes.withColumn("_d", F.to_date("ts")).join(near, [*keys, "_d"])
    noon = F.unix_micros(F.col("date").cast("timestamp")) + 43_200_000_000
    distance = F.abs(F.unix_micros("ts") - noon)
    return met.groupBy(*keys, "date").agg(
        F.min_by(F.struct("scene_id", "ts"), F.struct(distance.alias("x"), F.col("scene_id").alias("y"))).alias("_s")
    ).select(*keys, "date", "_s.scene_id", "_s.ts")


def resolve_granules(granules: DataFrame, chains: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """The granule behind each role of a chain: same day, platform and mode, most coverage.

    ``granules``: event_id, platform, mode, orbit_key, ts, cov, title. ``chains``: event_id,
    platform, rel_orbit, pre, post, control. Granules of the chain's orbit come first; without one
    the others stand in and ``rel_match`` is false. A missing role, or coverage under ``least``,
    is an error.
    """
    role = lambda r: F.struct(F.lit(r).alias("role"), F.col(r).alias("d"))
    roles = chains.select(
        "event_id", "platform", "rel_orbit", F.explode(F.array(role("pre"), role("post"), role("control"))).alias("_r")
    ).select("event_id", "platform", "rel_orbit", "_r.role", "_r.d")
    found = granules.where(F.col("mode") == "IW").withColumn("d", F.to_date("ts"))
    met = roles.join(found, ["event_id", "platform", "d"], "left")
    match = F.col("rel_orbit").isNull() | (F.col("orbit_key") == F.col("rel_orbit"))
    match = F.coalesce(match, F.lit(False))
    order = F.struct(match.alias("m"), "cov", F.col("title").alias("t"))
    picked = met.groupBy("event_id", "platform", "role", "d").agg(
        F.max_by(F.struct("title", "cov", match.alias("rel_match")), F.when(F.col("title").isNotNull(), order)).alias("_g")
    )
    fine = F.coalesce(F.round("_g.cov", 3) >= least, F.lit(False))
    title = F.when(fine, F.col("_g.title")).otherwise(F.raise_error(F.lit("granule missing or coverage too low")))
    return picked.select(
        "event_id", "platform", "role", "d", title.alias("title"), F.round("_g.cov", 3).alias("cov"),
        F.col("_g.rel_match").alias("rel_match"),
    )


def pass_frames(frames: DataFrame) -> DataFrame:
    """Frames seen in a pass window: count, channels, satellites and times. Sets are small by nature:
    channels, satellites, and seconds of one pass."""
    return frames.groupBy("track", "frame").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("pol")).alias("pols"),
        F.sort_array(F.collect_set(F.coalesce("sat", F.lit("?")))).alias("sats"),
        F.sort_array(F.collect_set("time")).alias("times"),
    )


# -- pair checks -------------------------------------------------------------------------------

def pair_issues(a: Column, b: Column) -> Column:
    """Errors and warnings of a target (``a``) and control (``b``) product struct."""
    ne = lambda f: ~a[f].eqNullSafe(b[f])
    both = lambda f: a[f].isNotNull() & b[f].isNotNull()
    family = ne("family")
    isce = ~family & F.coalesce(a["family"] == "isce", F.lit(False))
    gamma = ~family & F.coalesce(a["family"] == "gamma", F.lit(False))
    return F.array_compact(F.array(
        F.when(family, "error:family"),
        F.when(isce & ne("burst_key"), "error:burst"),
        F.when(isce & both("track") & ne("track"), "error:track"),
        F.when((isce | gamma) & ne("pol"), "error:pol"),
        F.when(gamma & both("orbit_code") & ne("orbit_code"), "warning:orbit_code"),
        F.when(both("spacing_m") & ne("spacing_m"), "warning:spacing"),
    ))


def temporal_issues(a: Column, b: Column, mode: str = "event_drop") -> Column:
    """Chronology errors and warnings of a target and control product struct."""
    if mode not in ("event_drop", "persistent_gain"):
        raise ValueError(f"unknown coherence mode: {mode}")
    day = lambda p, f: F.try_to_date(F.substring(p[f], 1, 8), "yyyyMMdd")
    a1, a2, b1, b2 = day(a, "date1"), day(a, "date2"), day(b, "date1"), day(b, "date2")
    known = a1.isNotNull() & a2.isNotNull() & b1.isNotNull() & b2.isNotNull()
    ordered = (a2 > a1) & (b2 > b1)
    fine = known & ordered
    checks = [
        F.when(~known, "warning:dates_unknown"),
        F.when(known & ~ordered, "error:not_increasing"),
        F.when(fine & (F.abs(F.datediff(a2, a1) - F.datediff(b2, b1)) > 1), "warning:baseline"),
    ]
    if mode == "persistent_gain":
        checks.append(F.when(fine & (b2 >= a1), "error:baseline_not_before"))
    else:
        checks.append(F.when(fine, "warning:confirm_straddle"))
    return F.array_compact(F.array(*checks))


def reject_errors(issues: Column) -> Column:
    """``issues`` unchanged, or a runtime error when one of them is an error."""
    bad = F.exists(issues, lambda i: i.startswith("error:"))
    return F.when(~bad, issues).otherwise(F.raise_error(F.concat(F.lit("product mismatch: "), F.array_join(issues, ", "))))
