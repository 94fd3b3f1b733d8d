import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deltacell import schema as S
from deltacell.functions import geometry as G
from deltacell.operators import objects
from deltacell.plans import detect

NAN = float("nan")


def grids(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], S.GRID)


def table(spark, arrays, **extra):
    parts = []
    for i, a in arrays.items():
        r, c = np.indices(a.shape)
        parts.append(pd.DataFrame({"grid_id": i, "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "value": a.ravel().astype(float)}))
    df = spark.createDataFrame(pd.concat(parts), "grid_id string, row int, col int, value double").withColumn("value", F.nanvl("value", F.lit(None)))
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def disc(n, r, at):
    y, x = np.ogrid[:n, :n]
    return (y - at[0]) ** 2 + (x - at[1]) ** 2 <= r * r


@pytest.mark.parametrize("gt, epsg", [([500000.0, 10.0, 0.0, 5000000.0, 0.0, -10.0], 32633), ([37.0, 0.0004, 0.0, 62.0, 0.0, -0.0002], 4326),
                                      ([4.0e6, 25.0, 0.0, 8.7e6, 0.0, -25.0], 3857)])
def test_equal_area_is_the_sum_of_its_cells(spark, gt, epsg):
    rng = np.random.default_rng(3)
    a = rng.random((60, 50)) < 0.45
    a[20:40, 10:30] = True
    a[25:30, 15:20] = False
    r, c = np.nonzero(a)
    mask = spark.createDataFrame(pd.DataFrame({"grid_id": "g", "row": r.astype("int32"), "col": c.astype("int32")}))
    labelled = objects.components(mask, 16)
    got = {x.label: x.area_m2 for x in objects.equal_area(labelled, grids(spark, [("g", 50, 60, gt, epsg)])).collect()}
    cell = labelled.select("label", G.equal_area_cell_m2(F.col("row"), F.col("col"), gt, epsg).alias("m2"))
    want = {x.label: x.m2 for x in cell.groupBy("label").agg(F.sum("m2").alias("m2")).collect()}
    assert got.keys() == want.keys() and len(got) > 5
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6)


def test_area_cut_and_hint(spark):
    a = np.zeros((30, 30))
    a[2:4, 2:5] = 1  # six cells
    a[10:20, 10:20] = 1
    mask = table(spark, {"north": a, "south": a}).where("value = 1").select("grid_id", "row", "col")
    # At 62 degrees Mercator metres are much too long: six cells cover less than six cells in the grid's own metres.
    g = grids(spark, [("north", 30, 30, [4.0e6, 40.0, 0.0, 8.86e6, 0.0, -40.0], 3857), ("south", 30, 30, [500000.0, 80.0, 0.0, 4.9e6, 0.0, -80.0], 32633)])
    found = objects.measured(objects.components(mask, 16), g, 6).collect()
    assert sorted((r.grid_id, r.n_px) for r in found) == [("north", 100), ("south", 6), ("south", 100)]
    hint = detect.posting_hint(g, 6).collect()
    assert [r.grid_id for r in hint] == ["north"] and hint[0].min_object_ha == pytest.approx(0.96) and "0.96 ha" in hint[0].hint


def pair(spark, target, control):
    return table(spark, target, role="target").unionByName(table(spark, control, role="control"))


def test_control_of_another_posting_is_aligned(spark):
    n = 60
    blob = disc(n, 8, (30, 30))
    target = {k: np.where(blob, 0.2, 0.8) for k in ("a", "b")}
    control = {"a": np.full((n, n), 0.8), "b": np.full((90, 90), 0.8)}
    control["b"][0, :] = -9999.0
    own = grids(spark, [("a", n, n, [500000.0, 80.0, 0.0, 5000000.0, 0.0, -80.0], 32633), ("b", n, n, [500000.0, 80.0, 0.0, 5000000.0, 0.0, -80.0], 32634)])
    other = grids(spark, [("a", n, n, [500000.0, 80.0, 0.0, 5000000.0, 0.0, -80.0], 32633), ("b", 90, 90, [499900.0, 60.0, 0.0, 5000100.0, 0.0, -60.0], 32634)])
    d = detect.detect_coherence(pair(spark, target, control), grids=own, control_grids=other, tile=32)
    for r in d.run.collect():
        assert r.n_objects == 1 and r.threshold == pytest.approx(0.25, abs=0.01) and r.error is None
        assert r.area_ha == pytest.approx(blob.sum() * 0.64, rel=0.05)
    score = d.index.where("grid_id = 'b'").toPandas()
    in_blob = blob[score.row, score.col]
    assert score.value[in_blob].mean() == pytest.approx(0.6, abs=0.01) and score.value[~in_blob].abs().max() < 0.01
    with pytest.raises(ValueError, match="target's grids"):
        detect.detect_coherence(pair(spark, target, control), control_grids=other)


def test_one_bad_grid_leaves_the_others(spark):
    n = 40
    good = np.where(disc(n, 6, (20, 20)), 0.2, 0.8)
    target = {"good": good, "bad": np.full((n, n), NAN)}
    control = {"good": np.full((n, n), 0.8), "bad": np.full((n, n), 0.8)}
    cells = pair(spark, target, control)
    with pytest.raises(ValueError, match="bad"):
        detect.detect_coherence(cells, tile=32)
    run = {r.grid_id: r for r in detect.detect_coherence(cells, tile=32, strict=False).run.collect()}
    assert run["good"].n_objects == 1 and run["good"].error is None
    assert run["bad"].n_objects == 0 and run["bad"].threshold is None and "no valid cells" in run["bad"].error


def test_amplitude_without_valid_cells(spark):
    rng = np.random.default_rng(1)
    parts = []
    for g, level in (("good", -12.0), ("bad", NAN)):
        for period in ("pre", "post"):
            a = level + rng.normal(0, 0.3, (30, 30)) + (4.0 * disc(30, 5, (15, 15)) if period == "post" else 0)
            parts.append(table(spark, {g: a}, period=period, scene_id=period, band="VV"))
    obs = parts[0]
    for p in parts[1:]:
        obs = obs.unionByName(p)
    for mode in ("adaptive", "fixed"):
        d = detect.detect_wi(obs, ["VV"], min_pixels=5, tile=32, mode=mode)
        run = {r.grid_id: r for r in d.run.collect()}
        assert run["good"].n_objects >= 1 and run["good"].error is None and "no valid cells" in run["bad"].error
        assert [r.grid_id for r in d.mask.select("grid_id").distinct().collect()] == ["good"]
    with pytest.raises(Exception, match="grid bad: no valid cells"):
        detect.reject_failed(d.run).collect()


def test_masks_on_a_grid_of_their_own(spark):
    n = 40
    a = np.where(disc(n, 5, (10, 10)) | disc(n, 5, (30, 30)), 0.2, 0.8)
    cells = pair(spark, {"g": a}, {"g": np.full((n, n), 0.8)})
    own = grids(spark, [("g", n, n, [0.0, 80.0, 0.0, 3200.0, 0.0, -80.0], 32633)])
    coarse = grids(spark, [("g", 8, 8, [0.0, 400.0, 0.0, 3200.0, 0.0, -400.0], 32633)])
    upper = table(spark, {"g": np.ones((4, 8))}).select("grid_id", "row", "col")
    d = detect.detect_coherence(cells, analysis=upper, grids=own, mask_grids=coarse, tile=32)
    assert d.objects.count() == 1 and d.mask.agg(F.max("row")).first()[0] < 20
