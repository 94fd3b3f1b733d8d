import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from deltacell import schema as S
from deltacell.operators import cover, focal, masks, objects, order, stack
from deltacell.operators.joins import salted_join
from deltacell.plans import detect, experiments
from deltacell.sources import catalogs, sinks


def cells(spark, a, role):
    r, c = np.indices(a.shape)
    return spark.createDataFrame(pd.DataFrame({
        "grid_id": "g", "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "role": role, "value": a.ravel(),
    }))


def test_aligned_control_ends_where_the_target_ends(spark):
    """A grid described larger than its cells has the edges of its cells."""
    rng = np.random.default_rng(4)
    own, control = rng.random((7, 20)), rng.random((4, 10))
    gt, coarse = [1000.0, 10.0, 0.0, 6000.0, 0.0, -10.0], [1003.0, 20.0, 0.0, 5997.0, 0.0, -20.0]
    both = cells(spark, own, "target").union(cells(spark, control, "control"))
    grid = lambda height, g: spark.createDataFrame([("g", 20, height, g, 32633, None)], S.GRID)

    def found(height):
        d = detect.detect_coherence(both, offset=0.0, min_pixels=1, tile=16, grids=grid(height, gt), control_grids=grid(height, coarse))
        return sorted(map(tuple, d.mask.collect())), d.index.count()

    exact, larger = found(7), found(60)
    assert larger == exact and exact[1] == 140 and exact[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_lookups_and_cell_masks_never_pass_the_driver(spark):
    rows = spark.range(50).selectExpr("id % 5 as k", "id")
    look = spark.range(5).selectExpr("id as k", "id * 2 as v")
    met = salted_join(rows, look, ["k"], "inner")
    assert "BroadcastHashJoin" not in plan(met) and met.count() == 50
    mask = spark.createDataFrame([("g", 1, 1)], "grid_id string, row int, col int")
    every = cells(spark, np.ones((3, 3)), "target")
    assert "BroadcastHashJoin" not in plan(masks.subtract(every, mask)) and masks.subtract(every, mask).count() == 8
    assert "BroadcastHashJoin" not in plan(stack.within(every, mask)) and stack.within(every, mask).count() == 1


def test_dated_pairs_are_near_pairs_inside_the_days(spark):
    rng = np.random.default_rng(8)
    day = lambda k: pd.Timestamp("1969-06-01").date() + pd.Timedelta(days=int(k))
    box = lambda w: (lambda x, y: (x, y, x + w, y + w))(*map(float, rng.integers(0, 60, 2)))
    events = [(i, None if i % 40 == 7 else day(rng.integers(0, 700)), *box(5.0)) for i in range(300)]
    sites = [(i, day(rng.integers(0, 600)), [None, day(650), day(-400)][i % 3], *box(17.0)) for i in range(40)]
    cols = "xmin double, ymin double, xmax double, ymax double"
    e = spark.createDataFrame(events, f"event_id long, date date, {cols}")
    s = spark.createDataFrame(sites, f"site_id long, d1 date, d2 date, {cols}")
    want = cover.near_events(e, s, 1.0, 10.0).join(s.select("site_id", "d1", "d2"), "site_id").join(e.select("event_id", "date"), "event_id")
    want = want.where(cover.within_days(F.col("d1"), F.col("d2"), F.col("date"))).select("site_id", "event_id")
    got = cover.near_dated(e, s, 1.0, 10.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50
    assert "BroadcastHashJoin" not in plan(got)


def test_coverage_cuts_each_pair_of_shapes_once(spark):
    """The rows that come out are joined with written shares, so shapes are not cut for every granule and event."""
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    ring = "array<struct<x:double,y:double>>"
    hulls = spark.createDataFrame([(i, box(float(i % 3), 0.0, 2.0)) for i in range(6)], f"event_id int, hull {ring}")
    rows = [(i, f"t{k}", (box(float(k % 2), 1.0, 2.0), None)) for i in range(6) for k in range(4)]
    rows += [(0, "far", (box(50.0, 50.0, 1.0), None)), (0, "none", (None, None)), (1, "other", (None, box(1.0, 0.0, 2.0)))]
    seen = spark.createDataFrame(rows, f"event_id int, title string, rings struct<as_given:{ring},swapped:{ring}>")
    got = catalogs.coverage(seen, hulls)
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {(i, f"t{k}"): max(0, 2 - abs(i % 3 - k % 2)) / 4 for i in range(6) for k in range(4)}
    want |= {(0, "far"): 0.0, (0, "none"): 0.0, (1, "other"): 1.0}
    assert {(r.event_id, r.title): r.cov for r in got.collect()} == want and got.columns == [*seen.columns, "cov"]


def test_collection_documents_are_bounded(spark, tmp_path):
    """A table of one partition becomes several documents, each complete, with every feature once."""
    ring = F.array(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.col("id").cast("double").alias("y")) for x in range(3)]))
    sites = spark.range(1, 1001, 1, 1).withColumn("rings", ring)
    sinks.write_collection(sites, str(tmp_path / "many"), doc_bytes=20_000)
    texts = [p.read_text() for p in (tmp_path / "many").glob("part-*")]
    assert len(texts) > 5 and max(map(len, texts)) < 30_000
    ids = [f["properties"]["id"] for t in texts for f in json.loads(t)["features"]]
    assert sorted(ids) == list(range(1, 1001))
    sinks.write_collection(sites, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    assert sorted(r.id for r in catalogs.read_sites(spark, str(tmp_path / "many")).collect()) == sorted(ids)


def test_later_rounds_scan_only_open_brackets(spark, monkeypatch):
    written = []
    settle = order.settle
    monkeypatch.setattr(order, "settle", lambda df: written.append(settle(df)) or written[-1])
    rows = spark.range(20000).selectExpr("id % 2 as k", "1000000 + (id * 7919 % 20011) / 1000 as v")
    got = order.quantiles(rows, ["k"], "v", {"a": 0.25, "b": 0.9}, task_rows=20, fan=16)
    want = rows.groupBy("k").agg(F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.9).alias("b"))
    assert sorted((r.k, r.a, r.b) for r in got.collect()) == sorted((r.k, r.a, r.b) for r in want.collect())
    scanned = [t.count() for t in written if t.columns == ["k", "_v"]]
    assert scanned and max(scanned) <= 5000


def test_composites_scan_one_window_and_only_wanted_bands(spark):
    """One window operator for rank and count, rows of a number per band and period, and no look-up of linear scenes."""
    rng = np.random.default_rng(5)
    rows = [("g", f"s{k % 3}", p, b, k % 4, k % 5, float(rng.uniform(-30, -1) if k % 3 == 1 and b == "VV" else rng.uniform(1, 9)))
            for k in range(200) for p in ("pre", "post") for b in ("VV", "VH", "HH")]
    obs = spark.createDataFrame(rows, "grid_id string, scene_id string, period string, band string, row int, col int, value double")
    flags = stack.scale_flags(obs).where("already_db")
    assert sorted((r.scene_id, r.band) for r in flags.collect()) == [("s1", "VV")]
    d = pd.DataFrame(rows, columns=obs.columns)
    d["db"] = np.where((d.scene_id == "s1") & (d.band == "VV"), d.value, 10 * np.log10(d.value.where(d.value > 0)))
    m = d[d.band != "HH"].groupby(["row", "col", "band", "period"])["db"].median().unstack(["band", "period"])
    want = (m["VV", "post"] - m["VV", "pre"] + m["VH", "post"] - m["VH", "pre"]).to_dict()
    cells_ = stack.change_index(stack.deltas(stack.to_decibels(obs), ["VV", "VH"]), ["VV", "VH"])
    got = {(r.row, r.col): r.value for r in cells_.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    text = cells_._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [") == 1
    assert stack.to_decibels(obs.where("band = 'VH'")).where("db is null").count() == 0


def test_masks_meet_the_index_once(spark, monkeypatch):
    """The filter carries the bits of a cell, so its masks are joined with the index once, not again behind it."""
    rng = np.random.default_rng(6)
    index = cells(spark, rng.random((9, 14)), "target")
    bits = index.withColumn("bits", F.col("row").cast("long") * 100 + F.col("col"))
    for tile in (4, 64):
        out = focal.filtered(bits, 3, 1, tile=tile, carry=["bits"])
        assert out.columns == ["grid_id", "row", "col", "value", "bits"] and out.where("bits <> row * 100 + col").count() == 0
        plain = focal.filtered(index, 3, 1, tile=tile)
        assert sorted(map(tuple, out.drop("bits").collect())) == sorted(map(tuple, plain.collect()))
    joined = []
    join = experiments.cell_join
    monkeypatch.setattr(experiments, "cell_join", lambda *a: joined.append(a) or join(*a))
    west = index.where("col < 7")
    m = experiments.mask_effect(index, {"none": None, "west": west}, index.where("col < 3"), 1, 0.1, 4)
    assert len(joined) == 1
    limits = {r["mask"]: r["threshold"] for r in m.collect()}
    a = np.array([r.value for r in index.collect()])
    assert np.isclose(limits["none"], a.mean() + 0.1)
    assert np.isclose(limits["west"], np.mean([r.value for r in west.collect()]) + 0.1)


def test_a_repeated_cell_is_labelled_once_without_a_shuffle_of_its_own(spark):
    mask = spark.createDataFrame([("g", 1, 1), ("g", 1, 2), ("g", 1, 1), ("g", 5, 5)], "grid_id string, row int, col int")
    parts = objects.tile_parts(mask, 4)
    assert sorted((r.row, r.col, r.part) for r in parts.collect()) == [(1, 1, 2**31 + 1), (1, 2, 2**31 + 1), (5, 5, 5 * 2**31 + 5)]
    assert "Aggregate" not in parts._jdf.queryExecution().optimizedPlan().toString()
