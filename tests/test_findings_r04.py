"""Steps that grew faster than their input, each on rows that show it."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from deltacell.functions import geometry as G
from deltacell.operators import cover
from deltacell.plans import sites as S


def test_site_funnel_seeks_a_chain_once_for_events_of_one_date_and_hull(spark, monkeypatch):
    square = lambda x, w: F.array(G.box_ring(*[F.lit(float(v)) for v in (x, 0, x + w, 1)]))
    events = spark.range(60).select(
        "id", F.lit("tornado").alias("type"), F.lit("High").alias("certainty"), F.lit(2017).alias("year"), F.lit("2017/07/01").alias("date_1"),
        F.lit(2.0).alias("area_km2"), F.lit(300.0).alias("mean_width_m"), F.lit(30.0).alias("wind_gust"),
        F.when(F.col("id") < 50, square(0, 1)).otherwise(square(5, 1)).alias("geom"),
    )
    # Id 7 twice with two shapes: its chain may use either.
    twice = events.where("id = 7").withColumn("geom", square(5, 1))
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    days = [dt.datetime(2017, 6, 24, 5), dt.datetime(2017, 7, 6, 5), dt.datetime(2017, 7, 18, 5)]
    granules = spark.createDataFrame([(f"g{x}{i}", t, float(x)) for x in (0, 5) for i, t in enumerate(days[:3 if x == 0 else 2])],
                                     "title string, ts timestamp, x double")
    ring = G.box_ring(F.col("x") - 1, F.lit(-1.0), F.col("x") + 2, F.lit(2.0))
    granules = granules.select("title", "ts", F.lit("S1A").alias("platform"), F.lit("IW").alias("mode"), F.lit(3).alias("orbit_key"),
                               F.struct(ring.alias("as_given"), none.alias("swapped")).alias("rings"), F.lit("3").alias("track_key"))
    land = events.select(S.event_key(F.col("id"), F.col("date_1")).alias("event_id"), F.lit(0.5).alias("forest_frac"),
                         F.lit(0.0).alias("water_frac"), F.lit(1.0).alias("slope_mean_deg")).distinct()
    rows, coverage = [], S.catalogs.coverage
    monkeypatch.setattr(S.catalogs, "coverage", lambda met, hulls: rows.append(met.count()) or coverage(met, hulls))
    out = S.site_funnel(events.union(twice), granules, land)
    chains = {r["event_id"]: (str(r["pre"]), str(r["post"]), str(r["control"]), r["min_coverage"]) for r in out["chains"].collect()}
    assert chains == {f"{i}_20170701": ("2017-06-24", "2017-07-06", "2017-07-18", 1.0) for i in range(50)}
    assert rows[0] <= 10


def test_site_match_compares_pairs_where_they_meet(spark, monkeypatch):
    rng = random.Random(3)

    def shape(size):
        """A star, at times with a hole or a second part."""
        x, y = rng.uniform(0, 900), rng.uniform(0, 900)
        star = lambda r, k: [(x + r * math.cos(a) * rng.uniform(0.4, 1), y + r * math.sin(a) * rng.uniform(0.4, 1))
                             for a in (2 * math.pi * i / k for i in range(k))]
        rings = [star(size, 9)] + ([star(size / 4, 5)] if rng.random() < 0.4 else [])
        xs, ys = zip(*rings[0], strict=True)
        return min(xs), min(ys), max(xs), max(ys), rings

    day = lambda most: dt.date(2017, 1, 1) + dt.timedelta(rng.randrange(most))
    kinds = "xmin double, ymin double, xmax double, ymax double, rings array<array<struct<x:double,y:double>>>"
    sites = [(f"s{i}", day(300), None if i % 3 else dt.date(2017, 11, 1), *shape(160)) for i in range(25)]
    events = [(i, day(400), *shape(60)) for i in range(400)]
    sites += [sites[0], (None, *sites[1][1:]), ("s90", None, *sites[2][2:]), ("s91", *sites[3][1:7], None)]
    events += [events[5], (7, *events[8][1:]), (None, *events[9][1:]), (900, None, *events[3][2:]), (901, *events[4][1:6], None)]
    s = spark.createDataFrame(sites, f"site_id string, d1 date, d2 date, {kinds}")
    e = spark.createDataFrame(events, f"event_id long, date date, {kinds}")
    grid = {"gt": [0.0, 10.0, 0.0, 1000.0, 0.0, -10.0], "width": 100, "height": 100}
    pairs = cover.near_dated(e, s, 0.0, 200.0)
    kept = cover.overlap(pairs, cover.spans(s, ["site_id"], grid), cover.spans(e, ["event_id"], grid), 100.0).where("inter_ha > 0")
    want = sorted(map(tuple, cover.best_matches(kept, 6).select("site_id", "event_id", "inter_ha", "iou", "rank").collect()))
    monkeypatch.setattr(cover, "near_dated", None)  # pairs are not written
    for most in (20_000, 7):
        monkeypatch.setattr(cover, "EVENTS", most)
        monkeypatch.setattr(cover, "SITES", most)
        got = S.site_matches(s, e, "rings", "rings", grid, 100.0, bucket=200.0)
        assert sorted(map(tuple, got.select("site_id", "event_id", "inter_ha", "iou", "rank").collect())) == want
    assert len(want) > 60
    assert S.site_matches(s.limit(0), e, "rings", "rings", grid, 100.0, bucket=200.0).collect() == []
