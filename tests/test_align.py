import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deltacell import schema as S
from deltacell.functions import crs
from deltacell.operators import align

GRIDS = [
    ("utm", 60, 50, [500000.0, 80.0, 0.0, 5004000.0, 0.0, -80.0], 32633),
    ("deg", 45, 40, [15.0, 0.0016, 0.0, 45.19, 0.0, -0.0012], 4326),
    ("far", 30, 30, [500500.0, 120.0, 0.0, 5004400.0, 0.0, -120.0], 32633),
]


def grids(spark, rows):
    return spark.createDataFrame([(i, w, h, gt, e, None) for i, w, h, gt, e in rows], S.GRID)


def field(rows):
    rng = np.random.default_rng(4)
    out = {}
    for i, w, h, _, _ in rows:
        a = rng.normal(size=(h, w))
        a[rng.random((h, w)) < 0.2] = np.nan
        out[i] = a
    return out


def frame(spark, arrays):
    parts = []
    for i, a in arrays.items():
        r, c = np.indices(a.shape)
        parts.append(pd.DataFrame({"grid_id": i, "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "value": a.ravel()}))
    df = spark.createDataFrame(pd.concat(parts), "grid_id string, row int, col int, value double")
    return df.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def positions(spark, target, source):
    """Rows and columns of the target's cell centres in the source, cell by cell through the fixed-CRS functions."""
    _, w, h, gt, e = target
    cells = spark.range(h).selectExpr("cast(id as int) row").crossJoin(spark.range(w).selectExpr("cast(id as int) col"))
    x, y = gt[0] + (F.col("col") + 0.5) * gt[1], gt[3] + (F.col("row") + 0.5) * gt[5]
    x, y = crs.reproject(x, y, e, source[4])
    s = source[3]
    found = cells.select("row", "col", ((y - s[3]) / s[5]).alias("r"), ((x - s[0]) / s[1]).alias("c")).toPandas()
    r, c = np.zeros((h, w)), np.zeros((h, w))
    r[found.row, found.col], c[found.row, found.col] = found.r, found.c
    return r, c


def sample(a, r, c, how):
    def at(i, j):
        return a[i, j] if 0 <= i < a.shape[0] and 0 <= j < a.shape[1] else math.nan

    if how == "nearest":
        return at(math.floor(r), math.floor(c))
    r, c = r - 0.5, c - 0.5
    i, j = math.floor(r), math.floor(c)
    parts = [((1 - abs(i + di - r)) * (1 - abs(j + dj - c)), at(i + di, j + dj)) for di in (0, 1) for dj in (0, 1)]
    parts = [(w, v) for w, v in parts if w > 1e-12 and not math.isnan(v)]
    return sum(w * v for w, v in parts) / sum(w for w, _ in parts) if parts else math.nan


@pytest.mark.parametrize("how", ["nearest", "bilinear"])
def test_grids_of_different_zone_and_size_in_one_job(spark, how):
    arrays = field(GRIDS)
    targets = [("utm", 20, 17, [500200.0, 150.0, 0.0, 5003800.0, 0.0, -150.0], 32632), ("deg", 33, 21, [500100.0, 95.0, 0.0, 5003000.0, 0.0, -95.0], 32633),
               ("far", 40, 10, [15.01, 0.0009, 0.0, 45.185, 0.0, -0.0009], 4326)]
    got = align.align(frame(spark, arrays), grids(spark, GRIDS), grids(spark, targets), how, tile=16).toPandas()
    assert len(got) == sum(w * h for _, w, h, _, _ in targets)
    for target, source in zip(targets, GRIDS):
        r, c = positions(spark, target, source)
        own = got[got.grid_id == target[0]]
        known = 0
        for t in own.itertuples():
            want = sample(arrays[target[0]], r[t.row, t.col], c[t.row, t.col], how)
            assert (math.isnan(want) and math.isnan(t.value)) or t.value == pytest.approx(want, abs=1e-6)
            known += not math.isnan(want)
        assert known > (0.5 if target[0] != "utm" else 0) * len(own) or target[0] == "utm"


def test_one_source_serves_many_targets_and_only_needed_tiles_move(spark):
    source = [("big", 1500, 1200, [0.0, 10.0, 0.0, 12000.0, 0.0, -10.0], 32633)]
    a = np.arange(1500 * 1200, dtype=float).reshape(1200, 1500)
    targets = spark.createDataFrame(
        [(f"t{k}", 30, 30, [500.0 + 900 * k, 20.0, 0.0, 11000.0 - 700 * k, 0.0, -20.0], 32633, "big") for k in range(6)],
        "grid_id string, width int, height int, gt array<double>, epsg int, source_id string",
    )
    cells = frame(spark, {"big": a})
    got = align.align(cells, grids(spark, source), targets).toPandas()
    for t in got.itertuples():
        k = int(t.grid_id[1:])
        x, y = 500.0 + 900 * k + 20 * (t.col + 0.5), 11000.0 - 700 * k - 20 * (t.row + 0.5)
        assert t.value == a[int((12000 - y) // 10), int(x // 10)]
    windows = align.tile_windows(align.pairs(grids(spark, source), targets))
    needed = align.needed_tiles(windows, []).distinct().count()
    assert needed <= 14 < 30
    mean = align.average(cells, grids(spark, source), targets).toPandas()
    assert len(mean) == 6 * 900
    for t in mean.sample(200, random_state=1).itertuples():
        k = int(t.grid_id[1:])
        c, r = 50 + 90 * k + 2 * t.col, 100 + 70 * k + 2 * t.row
        assert t.value == pytest.approx(a[r:r + 2, c:c + 2].mean())


def test_same_grid_passes_and_bad_input_stops(spark):
    arrays = field(GRIDS)
    cells = frame(spark, arrays)
    assert sorted(map(str, align.onto(cells, grids(spark, GRIDS), grids(spark, GRIDS)).collect())) == sorted(map(str, cells.collect()))
    moved = [GRIDS[0], ("deg", 10, 10, [15.0, 0.0016, 0.0, 45.19, 0.0, -0.0012], 4326)]
    got = align.onto(cells, grids(spark, GRIDS), grids(spark, moved)).toPandas()
    deg = got[got.grid_id == "deg"]
    assert len(got) == 3000 + 100 and len(deg) == 100
    for t in deg.itertuples():
        want = arrays["deg"][t.row, t.col]
        assert (math.isnan(want) and math.isnan(t.value)) or t.value == want
    with pytest.raises(Exception, match="no source grid"):
        align.align(cells, grids(spark, GRIDS[:1]), grids(spark, GRIDS)).collect()
    with pytest.raises(ValueError, match="unknown resampling"):
        align.align(cells, grids(spark, GRIDS), grids(spark, GRIDS), "cubic")
    assert align.align(cells.where("false"), grids(spark, GRIDS), grids(spark, GRIDS)).where("value is not null").count() == 0
