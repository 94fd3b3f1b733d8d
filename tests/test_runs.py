import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltacell.operators import screening as X
from deltacell.plans import detect
from deltacell.session import scratch_root, settle
from deltacell.sources import catalogs, sinks, tables
from deltacell.streaming import incremental


def disc(n, r, at):
    y, x = np.ogrid[:n, :n]
    return (y - at[0]) ** 2 + (x - at[1]) ** 2 <= r * r


@pytest.fixture(scope="module")
def scene():
    """Two bands before and after, one disc brighter by 4 dB after."""
    rng = np.random.default_rng(42)
    blob = disc(80, 10, (40, 40))
    pre = {b: np.full((80, 80), v) + 0.0 for b, v in (("VV", -12.0), ("VH", -18.0))}
    post = {b: a + rng.normal(0, 0.4, a.shape) + 4.0 * blob for b, a in pre.items()}
    return pre, post, blob


def observations(spark, pre, post, shift=0.0):
    import pandas as pd

    parts = []
    for period, layers, add in (("pre", pre, 0.0), ("post", post, shift)):
        for band, a in layers.items():
            r, c = np.indices(a.shape)
            parts.append(pd.DataFrame({
                "grid_id": "g", "scene_id": period, "period": period, "band": band, "row": r.ravel().astype("int32"),
                "col": c.ravel().astype("int32"), "value": (a + add).ravel(),
            }))
    return settle(spark.createDataFrame(pd.concat(parts)).repartition(4))


def test_detection(spark, scene):
    pre, post, blob = scene
    d = detect.detect_wi(observations(spark, pre, post), tile=32)
    t = d.run.first()
    index = d.index.agg(F.avg("value")).first()[0]
    assert t["threshold"] == pytest.approx(index + 2.9)
    got = np.zeros_like(blob)
    for r in d.mask.collect():
        got[r["row"], r["col"]] = True
    assert got[blob].mean() > 0.9 and got[~blob].mean() < 0.05
    assert t["max_area_ha"] == pytest.approx(3.14, rel=0.35)


def test_normalised_shift_changes_no_object(spark, scene):
    pre, post, _ = scene
    plain = detect.detect_wi(observations(spark, pre, post), tile=32)
    moved = detect.detect_wi(observations(spark, pre, post, 1.5), normalize=True, tile=32)
    o = moved.extras["offsets"].first()
    assert o["o_VV"] == pytest.approx(1.5, abs=0.1) and o["o_VH"] == pytest.approx(1.5, abs=0.1)
    key = lambda d: {(r["row"], r["col"]) for r in d.mask.collect()}
    assert key(plain) == key(moved)


def test_decline_and_band_choice(spark, scene):
    pre, post, blob = scene
    flip = {"HH": pre["VV"] - (post["VV"] - pre["VV"])}
    d = detect.detect_lband(observations(spark, {"HH": pre["VV"]}, flip), ["HH"], offset=1.5, tile=32)
    hits = sum(blob[r["row"], r["col"]] for r in d.mask.collect())
    assert hits > 0.6 * blob.sum()
    assert detect.lband_bands(["VV"]) == (["VV"], True)
    with pytest.raises(ValueError):
        detect.lband_bands(["VV"], ["HV"])


def test_coherence_detection(spark):
    blob = disc(60, 8, (30, 30))
    rows = [
        ("g", int(r), int(c), role, float(0.2 if role == "target" and blob[r, c] else 0.8))
        for r in range(60) for c in range(60) for role in ("target", "control")
    ]
    coh = spark.createDataFrame(rows, "grid_id string, row int, col int, role string, value double")
    half = spark.createDataFrame([("g", r, c) for r in range(60) for c in range(10)], "grid_id string, row int, col int")
    a = "/x/S1AB_20170912T030234_20170924T030301_VVP012_INT80_G_ueF_5748.zip"
    b = "/x/S1AB_20170924T030234_20171006T030301_VVP012_INT80_G_ueF_5748.zip"
    pairs = spark.createDataFrame([("g", a, b)], "grid_id string, target string, control string")
    d = detect.detect_coherence(coh, background=half, products=pairs, tile=32)
    assert d.run.first()["threshold"] == pytest.approx(0.25) and d.run.first()["n_objects"] == 1
    s = d.extras["safeguard"].first()
    assert s["flagged"] and set(s["reasons"]) == {"high_coherence", "low_forest_share"} and s["zone"] == "background"
    assert d.extras["issues"].first()["issues"] == ["warning:confirm_straddle"]


def test_event_scan_and_funnel(spark, tmp_path):
    row = {"id": 1, "type": "tornado", "certainty": "High", "year": 2016, "date_1": "2016/06/05", "date_2": "-9999", "area_km2": 2.0,
           "mean_width_m": -9999.0, "wind_gust": -9999}
    p = tmp_path / "e.json"
    p.write_text("\n".join(json.dumps({**row, "id": i, "mean_width_m": w}) for i, w in ((1, -9999.0), (2, 200.0))))
    e = tables.read_events(spark, str(p), "json")
    assert e.where("wind_gust is not null or date_2 is not null").isEmpty()
    counts = {r["step"]: r["n"] for r in X.funnel_counts(e, X.funnel_steps()).collect()}
    assert counts["base_pool"] == 2 and counts["width"] == 1 and counts["high"] == 1


def test_legacy_csv(spark, tmp_path):
    lines = ["preamble"] * 31 + ["ID;Ширина;Тип", "1;12,5;шквал", "/* note", "2;нет;смерч", ""]
    (tmp_path / "f.csv").write_bytes("\r\n".join(lines).encode("cp1251"))
    t = tables.read_legacy_csv(spark, str(tmp_path), {"ID": "id int", "Ширина": "width double", "Тип": "type string"})
    assert [(r["id"], r["width"], r["type"]) for r in t.orderBy("id").collect()] == [(1, 12.5, "шквал"), (2, None, "смерч")]


def test_stac_and_cmr(spark, tmp_path):
    item = {"id": "s1", "collection": "grd", "bbox": [1, 1, 2, 2], "properties": {"datetime": "2017-06-05T01:02:03Z", "sar:polarizations": ["vv"], "sat:orbit_state": "Descending"},
            "assets": {"vv": {"href": "a"}, "thumbnail": {"href": "t"}}}
    (tmp_path / "stac").mkdir()
    (tmp_path / "stac" / "p.json").write_text(json.dumps({"features": [item, item]}))
    s = catalogs.read_stac(spark, str(tmp_path / "stac"))
    one = catalogs.split_assets(catalogs.first_per_id(s)).collect()
    assert len(one) == 1 and one[0]["polarizations"] == ["VV"] and one[0]["preview_url"] == "t" and one[0]["assets"] == {"vv": "a"}
    k = catalogs.skip_counts(s, polarizations=["VV"], orbit="Ascending").first()
    assert (k["duplicates"], k["orbit_mismatch"], k["kept"]) == (1, 1, 0)
    title = "S1B_IW_SLC__1SDV_20170616T033238_20170616T033305_006070_00AA11_6660"
    feed = {"feed": {"entry": [{"title": title, "time_start": "2017-06-16T03:32:38.000Z", "polygons": [["50 40 50 41 51 41 51 40"]], "orbit_calculated_spatial_domains": [{"orbit_number": "6070"}]}]}}
    (tmp_path / "cmr").mkdir()
    (tmp_path / "cmr" / "p.json").write_text(json.dumps(feed))
    g = catalogs.read_cmr(spark, str(tmp_path / "cmr")).first()
    assert (g["platform"], g["mode"], g["orbit_key"]) == ("S1B", "IW", 6070 % 175) and g["rings"]["as_given"] is not None


def test_sinks_and_incremental(spark, tmp_path, cells):
    a = np.array([[1.0, np.nan], [2.0, 3.0]])
    sinks.write_index(cells(a), str(tmp_path / "index"), -9999.0)
    assert spark.read.parquet(str(tmp_path / "index")).where("value = -9999").count() == 1
    events = spark.createDataFrame([(1,), (2,), (3,)], "event_id int")
    seen = []

    def evaluate(todo):
        seen.append({r[0] for r in todo.collect()})
        return todo.where("event_id <> 3").withColumn("auc", F.lit(0.5))

    path = str(tmp_path / "results")
    incremental.append_results(events.where("event_id < 2"), path, evaluate)
    incremental.append_results(events, path, evaluate)
    incremental.append_results(events, path, evaluate)
    rows = [(r["event_id"], r["error"]) for r in incremental.latest(spark, path).orderBy("event_id").collect()]
    assert seen == [{1}, {2, 3}, {3}] and rows == [(1, None), (2, None), (3, "no result")]
    f = sinks.site_features(spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]])], "id int, rings array<array<struct<x:double,y:double>>>"))
    doc = json.loads(f.first()["value"])
    assert doc["properties"] == {"id": 1} and doc["geometry"]["coordinates"][0][0][0] == [0.0, 0.0] and len(doc["geometry"]["coordinates"][0][0]) == 4


def test_holes_stay_holes(spark):
    def square(at, size):
        return [{"x": at + dx * size, "y": at + dy * size} for dx, dy in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]

    rings = [square(0.0, 10.0), square(2.0, 6.0), square(3.0, 2.0), square(20.0, 1.0)]
    f = sinks.site_features(spark.createDataFrame([(1, rings)], "id int, rings array<array<struct<x:double,y:double>>>"))
    polygons = json.loads(f.first()["value"])["geometry"]["coordinates"]
    assert [[r[0][0] for r in p] for p in polygons] == [[0.0, 2.0], [3.0], [20.0]]


def test_scratch_is_the_named_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_cohort_incomplete_is_an_error(spark):
    df = spark.createDataFrame([(1, "tornado", 2016, "full", 0.5)], "id int, type string, year int, quality string, score double")
    with pytest.raises(ValueError):
        X.cohort(df)


def test_one_broken_event_and_a_repeated_write(spark, tmp_path):
    """A raise names its event and leaves the others; a run over the same events has no row twice."""
    events = spark.createDataFrame([(f"0{i}", i) for i in range(12)], "event_id string, v int")
    path, tried = str(tmp_path / "results"), []

    def evaluate(todo, broken=7):
        tried.append(1)
        bad = F.when(F.col("v") == broken, F.raise_error(F.lit("no cells"))).otherwise(F.lit(0.5))
        return todo.select("event_id", "v", (bad + F.col("v")).alias("auc"))

    incremental.append_results(events, path, evaluate)
    rows = {r["event_id"]: r for r in incremental.latest(spark, path).collect()}
    assert len(rows) == 12 and [k for k, r in rows.items() if r["error"]] == ["07"] and "no cells" in rows["07"]["error"]
    assert all(r["auc"] == r["v"] + 0.5 for k, r in rows.items() if k != "07") and len(tried) <= 2 * 8 + 1
    seen = {r[0] for r in incremental.pending(events, path).select("event_id").collect()}
    assert seen == {"07"}
    # As if a first write had been killed after its folders: the same events stored again.
    incremental._store(evaluate(events, -1).withColumn("error", F.lit(None)), path, "event_id")
    assert incremental.latest(spark, path).where("error is null").count() == 12
    assert incremental.latest(spark, path).select("event_id").distinct().count() == 12


def test_hull_of_any_points(spark):
    from deltacell.functions.hull import convex_hull

    def ring(*points):
        return [[{"x": float(x), "y": float(y)} for x, y in points]]

    shapes = {
        "grid": ring(*[(i % 5, i // 5) for i in range(25)]), "line": ring((0, 0), (1, 1), (2, 2), (1, 1)),
        "point": ring((3, 4), (3, 4)), "none": None, "empty": [[]], "dented": ring((0, 0), (4, 0), (1, 1), (0, 4), (0, 2)),
    }
    df = spark.createDataFrame(list(shapes.items()), "k string, rings array<array<struct<x:double,y:double>>>")
    out = {r["k"]: r["h"] and [(p["x"], p["y"]) for p in r["h"]] for r in df.select("k", convex_hull("rings").alias("h")).collect()}
    assert out["grid"] == [(0, 0), (4, 0), (4, 4), (0, 4)] and out["line"] == [(0, 0), (2, 2)] and out["point"] == [(3, 4)]
    assert out["none"] is None and out["empty"] == [] and out["dented"] == [(0, 0), (4, 0), (0, 4)]
