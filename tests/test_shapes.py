import numpy as np
import pytest
from pyspark.sql import functions as F

from deltacell.functions import geometry as G
from deltacell.functions.hull import convex_hull
from deltacell.operators import cover, masks, resample

GRID = {"gt": [0.0, 10.0, 0.0, 300.0, 0.0, -10.0], "epsg": 32633, "width": 40, "height": 30}


def rings(*shapes):
    return [[{"x": float(x), "y": float(y)} for x, y in s] for s in shapes]


@pytest.fixture
def polygons(spark):
    outer = [(13.0, 17.0), (351.0, 61.0), (290.0, 283.0), (180.0, 120.0), (60.0, 270.0)]
    hole = [(200.0, 60.0), (260.0, 70.0), (250.0, 140.0)]
    return spark.createDataFrame([(1, rings(outer, hole))], "id int, rings array<array<struct<x:double,y:double>>>"), (outer, hole)


def inside(x, y, shapes):
    hit = False
    for s in shapes:
        for (x1, y1), (x2, y2) in zip(s, s[1:] + s[:1]):
            if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                hit = not hit
    return hit


def test_burn(polygons):
    df, shapes = polygons
    got = {(r["row"], r["col"]) for r in cover.burn(df, ["id"], GRID).collect()}
    want = {(r, c) for r in range(30) for c in range(40) if inside(c * 10 + 5, 300 - (r * 10 + 5), shapes)}
    assert got == want


def test_hull_and_area(polygons):
    df, (outer, _) = polygons
    out = df.select(convex_hull("rings").alias("h"), G.rings_area(F.col("rings")).alias("a")).first()
    assert {(p["x"], p["y"]) for p in out["h"]} == set(outer) - {(180.0, 120.0)}


def test_box_coverage_and_axis_order(spark):
    df = spark.createDataFrame([("40 50 41 50 41 51 40 51",), ("50 40 50 41 51 41 51 40",), ("1 2 3",)], "t string")
    box = [F.lit(v) for v in (40.5, 50.0, 41.5, 51.0)]
    ring = G.pick_ring_reading(G.parse_ring(F.col("t")), *box)
    assert [r[0] for r in df.select(G.box_coverage(ring, *box)).collect()] == [pytest.approx(0.5), pytest.approx(0.5), None]


def test_tiles(spark):
    df = spark.createDataFrame([(29.5, 49.5, 30.5, 61.0)], "xmin double, ymin double, xmax double, ymax double")
    out = [r["tile"] for r in G.tiles_for_bbox(df).orderBy("tile_row", "tile_col").collect()]
    assert out == ["70N_020E", "70N_030E", "60N_020E", "60N_030E", "50N_020E", "50N_030E"]
    with pytest.raises(Exception, match="invalid bbox"):
        G.tiles_for_bbox(df.withColumn("ymax", F.lit(85.0))).collect()


def test_window_bounds():
    assert G.window_bounds([15.0, 205.0, 31.0, 260.0], GRID["gt"], 40, 30) == (4, 9, 1, 3)
    assert G.window_bounds([-50.0, 0.0, -10.0, 50.0], GRID["gt"], 40, 30) is None


def test_resampling(cells, array):
    a = np.random.default_rng(3).normal(size=(30, 40))
    a[4:9, 4:9] = np.nan
    target = {"gt": [3.0, 25.0, 0.0, 290.0, 0.0, -25.0], "epsg": 32633, "width": 15, "height": 11}
    near = array(resample.nearest(cells(a), GRID, target), (11, 15))
    for r in range(11):
        for c in range(15):
            sr, sc = int((300 - (290 - 25 * (r + 0.5))) // 10), int((3 + 25 * (c + 0.5)) // 10)
            want = a[sr, sc] if 0 <= sr < 30 and 0 <= sc < 40 else np.nan
            np.testing.assert_equal(near[r, c], want)
    flat = cells(np.full((30, 40), 7.0))
    inner = array(resample.bilinear(flat, GRID, target), (11, 15))
    assert np.nanmin(inner) == pytest.approx(7.0) and np.nanmax(inner) == pytest.approx(7.0)
    assert resample.nearest(flat, GRID, GRID) is flat


def test_first_scene_wins(spark):
    rows = [("g", 0, 0, 0, 0.0), ("g", 0, 0, 1, 5.0), ("g", 0, 0, 2, 9.0), ("g", 0, 1, 0, 3.0)]
    df = spark.createDataFrame(rows, "grid_id string, row int, col int, ord int, value double")
    assert {(r["col"], r["value"]) for r in resample.first_wins(df, "ord").collect()} == {(0, 5.0), (1, 3.0)}


def test_mask_outside_grid_is_an_error(spark, cells):
    grid = spark.createDataFrame([("g", 2, 3)], "grid_id string, height int, width int")
    assert masks.check_grid(cells(np.ones((2, 3))), grid).count() == 6
    with pytest.raises(Exception, match="outside its grid"):
        masks.check_grid(cells(np.ones((3, 3))), grid).collect()


def test_matching_by_buckets(spark):
    rng = np.random.default_rng(0)
    def boxes(n, size, name):
        rows = [(i, float(x), float(y), float(x + size), float(y + size)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (n, 2)))]
        return rows, spark.createDataFrame(rows, f"{name} int, xmin double, ymin double, xmax double, ymax double")
    sites, s = boxes(25, 0.6, "site_id")
    events, e = boxes(120, 0.9, "event_id")
    got = [(r["site_id"], r["event_id"]) for r in cover.near_events(e, s, 0.15, 0.5).collect()]
    want = {(a[0], b[0]) for a in sites for b in events if a[1] - 0.15 <= b[3] and a[3] + 0.15 >= b[1] and a[2] - 0.15 <= b[4] and a[4] + 0.15 >= b[2]}
    assert len(got) == len(set(got)) and set(got) == want
