import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltacell.functions import crs
from deltacell.functions import dates as D
from deltacell.functions import naming as N
from deltacell.functions import radiometry as R
from deltacell.operators import chains as C
from deltacell.operators import stack


def test_decibels(spark):
    df = spark.createDataFrame([(100.0,), (1.0,), (0.0,), (-4.0,), (None,)], "v double")
    out = [r[0] for r in df.select(R.to_db(F.col("v"))).collect()]
    assert out == [20.0, 0.0, None, None, None]
    assert df.limit(1).select(R.from_db(R.to_db(F.col("v")))).first()[0] == pytest.approx(100.0)


@pytest.mark.parametrize("values, expected", [([-15.0, -14.0], True), ([0.3, 0.2], False), ([1000.0, -32768.0], False), ([None, None], False)])
def test_scale_detection(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(R.is_db(F.col("v"))).first()[0] is expected


def test_annual_forest(spark):
    cover = [[80, 80, 80, 10], [80, 80, 80, 80]]
    loss = [[0, 17, 16, 0], [18, 5, 0, 17]]
    rows = [(r, c, cover[r][c], loss[r][c]) for r in range(2) for c in range(4)]
    df = spark.createDataFrame(rows, "row int, col int, cover int, loss int").orderBy("row", "col")
    a, b = F.col("cover"), F.col("loss")
    out = df.select(R.forest_candidate(a, b, 2017), R.forest_background(a, b, 2017), R.forest_candidate(a, b, 1999)).collect()
    assert [r[0] for r in out] == [True, True, False, False, True, False, True, True]
    assert [r[1] for r in out] == [True, False, False, False, True, False, True, False]
    assert [r[2] for r in out] == [True, True, True, False, True, True, True, True]


def test_coherence_score(spark):
    df = spark.createDataFrame([(0.12, 0.34), (0.19, 0.20), (None, 0.50)], "t double, c double")
    out = [r[0] for r in df.select(R.coherence_score(F.col("t"), F.col("c"))).collect()]
    assert out[:2] == pytest.approx([0.22, 0.01]) and out[2] is None
    with pytest.raises(ValueError):
        R.coherence_score(F.col("t"), F.col("c"), "other")


def test_composite_and_index(spark):
    rows = []
    for band, base in (("VV", -12.0), ("VH", -18.0)):
        for scene, period, shift in (("a", "pre", 0.0), ("b", "pre", 2.0), ("c", "pre", None), ("d", "post", 4.0)):
            v = None if shift is None else base + shift
            rows.append(("g", scene, period, band, 0, 0, v))
    rows += [("g", "a", "pre", "VV", 0, 1, -12.0), ("g", "d", "post", "VV", 0, 1, -11.0), ("g", "d", "post", "VH", 0, 1, None)]
    obs = spark.createDataFrame(rows, "grid_id string, scene_id string, period string, band string, row int, col int, db double")
    out = {r["col"]: r["value"] for r in stack.change_index(stack.deltas(obs, ["VV", "VH"]), ["VV", "VH"]).collect()}
    assert out[0] == pytest.approx(6.0)
    assert out[1] is None
    with pytest.raises(ValueError):
        stack.weighted_index({})


def test_names(spark):
    rows = [
        ("/d/S1AB_20170912T030234_20170924T030301_VVP012_INT80_G_ueF_5748.zip", "gamma", "A", None, "VV", 80, "5748"),
        ("/d/S1_123_111111s1n02-111111s2n01-000000s3n00_IW_20240101_20240115_VV_INT80_AEB4/x_corr.tif", "isce", None, 123, "VV", 80, "AEB4"),
        ("/d/mine/scene.tif", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string")
    out = df.select(N.parse_product(F.col("p")).alias("x")).select("x.*").collect()
    for got, want in zip(out, rows):
        assert tuple(got[c] for c in ("family", "platform", "track", "pol", "spacing_m", "pid")) == want[1:]
    assert out[2]["granule"] == "mine"


def test_polarization_token(spark):
    names = {"a/S1A_x_vv.tif": "VV", "s1a-iw-grd-vh-001.tiff": "VH", "vvpanel.tif": "", "hh_x.tif": "HH"}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r[0]: r[1] for r in df.select("p", N.polarization(F.col("p"))).collect()} == names


def test_pair_rules(spark):
    a = "/x/S1AB_20170912T030234_20170924T030301_VVP012_INT80_G_ueF_5748.zip"
    b = "/x/S1AB_20170924T030234_20171012T030301_VHP018_INT40_G_ueF_5748.zip"
    df = spark.createDataFrame([(a, b), (a, a)], "a string, b string")
    p, q = N.parse_product(F.col("a")), N.parse_product(F.col("b"))
    out = df.select(C.pair_issues(p, q), C.temporal_issues(p, q), C.temporal_issues(p, q, "persistent_gain")).collect()
    assert out[0][0] == ["error:pol", "warning:orbit_code", "warning:spacing"] and out[1][0] == []
    assert out[0][1] == ["warning:baseline", "warning:confirm_straddle"]
    assert out[0][2] == ["warning:baseline", "error:baseline_not_before"]
    with pytest.raises(Exception, match="product mismatch"):
        df.select(C.reject_errors(C.pair_issues(p, q))).collect()


def test_dates(spark):
    df = spark.createDataFrame([("04.09.2017",), ("2017/06/05",), ("2017-06-05T10:00:00",), ("nonsense",), ("-9999",)], "t string")
    assert [str(r[0]) for r in df.select(D.parse_date(F.col("t"))).collect()] == ["2017-09-04", "2017-06-05", "2017-06-05", "None", "None"]


def test_utm_known_points(spark):
    df = spark.createDataFrame([(15.0, 45.0), (9.0, 0.0)], "lon double, lat double")
    x, y = crs.lonlat_to_utm(F.col("lon"), F.col("lat"), crs.utm_epsg(F.col("lon")))
    out = df.select(x, y, crs.utm_epsg(F.col("lon"))).collect()
    assert out[0][0] == pytest.approx(500000.0, abs=1e-3) and out[0][1] == pytest.approx(4982950.4002, abs=1e-3)
    assert out[0][2] == 32633 and out[1][1] == pytest.approx(0.0, abs=1e-6)


@pytest.mark.parametrize("epsg", [3857, 6933, 32633])
def test_round_trips(spark, epsg):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(10, 20, 50), rng.uniform(-60, 75, 50))], "lon double, lat double")
    x, y = crs.from_lonlat(F.col("lon"), F.col("lat"), epsg)
    there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = crs.to_lonlat(F.col("x"), F.col("y"), epsg)
    for r in there.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert math.hypot(r["lon"] - r["a"], r["lat"] - r["b"]) < 1e-9
