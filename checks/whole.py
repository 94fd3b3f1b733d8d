"""Whole detections, masks and evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.cells import _AUC, _SENS, _window_sql
from checks.registry import query, r6
from checks.shapes import SOURCE, TARGET
from deltacell.operators import objects, screening, stack
from deltacell.operators.joins import attach
from deltacell.plans import detect, experiments, forest
from deltacell.plans import sites as P
from deltacell.session import settle
from deltacell.sources import sinks

CELL = ["grid_id", "row", "col"]
TILE = 64


def _components_sql(source: str, p: str = "") -> str:
    """8-connected labels of a cell table; ``p`` prefixes the CTE names."""
    return f"""
, {p}near AS (SELECT a.grid_id, a."row" AS r1, a.col AS c1, b."row" AS r2, b.col AS c2 FROM {source} a JOIN {source} b
  ON a.grid_id = b.grid_id AND b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1),
{p}reach AS (SELECT grid_id, "row" AS r0, col AS c0, "row", col FROM {source}
  UNION SELECT {p}reach.grid_id, r0, c0, r2, c2 FROM {p}reach JOIN {p}near ON {p}near.grid_id = {p}reach.grid_id AND {p}near.r1 = {p}reach."row" AND {p}near.c1 = {p}reach.col),
{p}lab AS (SELECT grid_id, r0 AS "row", c0 AS col, min("row" * 2147483648 + col) AS label FROM {p}reach GROUP BY ALL)"""


def _filtered_sql(view: str, name: str) -> str:
    """3 x 3 median of a dense view as CTE ``name``."""
    return _window_sql(view, 1) + f"""
, {name} AS (SELECT grid_id, "row", col, CASE WHEN any_value(centre) IS NOT NULL THEN median(v) END AS value FROM win GROUP BY grid_id, "row", col)"""


_DETECTED = """
, big AS (SELECT grid_id, label, count(*) AS n FROM lab GROUP BY ALL HAVING count(*) >= {n}),
runs AS (SELECT grid_id, count(*) AS n_objects, sum(n)::BIGINT AS n_px, round(sum(n) * {m2} / 1e4, 6) AS area_ha FROM big GROUP BY grid_id)
SELECT grid_id, round(threshold, 6) AS threshold, coalesce(n_objects, 0) AS n_objects, coalesce(n_px, 0) AS n_px, coalesce(area_ha, 0.0::DOUBLE) AS area_ha
FROM t LEFT JOIN runs USING (grid_id)"""


def _run(d):
    return d.run.select("grid_id", r6("threshold").alias("threshold"), "n_objects", "n_px", r6("area_ha").alias("area_ha"))


@query("detect_wi", _filtered_sql("wi", "m") + """
, t AS (SELECT grid_id, avg(value) + 0.6 AS threshold FROM wi GROUP BY grid_id), f AS (SELECT grid_id, "row", col FROM m JOIN t USING (grid_id) WHERE value > threshold)"""
       + _components_sql("f") + _DETECTED.format(n=5, m2="100.0::DOUBLE"), "stack db deltas wi")
def detect_wi(spark, sf):
    return _run(detect.detect_wi(V.stack(spark, sf), offset=0.6, min_pixels=5, tile=TILE))


@query("detect_wi_normalized", """
, offs AS (SELECT grid_id, coalesce(median(d_VV), 0) AS a, coalesce(median(d_VH), 0) AS b FROM deltas WHERE col < 15 GROUP BY grid_id),
ni AS (SELECT grid_id, "row", col, (d_VV - a) + (d_VH - b) AS value FROM deltas JOIN offs USING (grid_id))""" + _filtered_sql("ni", "m") + """
, t AS (SELECT grid_id, 0.5::DOUBLE AS threshold FROM ni GROUP BY grid_id), f AS (SELECT grid_id, "row", col FROM m JOIN t USING (grid_id) WHERE value > threshold AND col >= 10)"""
       + _components_sql("f") + _DETECTED.format(n=3, m2="100.0::DOUBLE"), "stack db deltas")
def detect_wi_normalized(spark, sf):
    obs = V.stack(spark, sf)
    cells = obs.select(*CELL).distinct()
    return _run(detect.detect_wi(
        obs, mode="fixed", fixed=0.5, normalize=True, background=cells.where("col < 15"), analysis=cells.where("col >= 10"), min_pixels=3, tile=TILE
    ))


@query("detect_decline", """
, li AS (SELECT grid_id, "row", col, -(median(v) FILTER (period = 'post') - median(v) FILTER (period = 'pre')) AS value FROM db WHERE band = 'HH' GROUP BY grid_id, "row", col)"""
       + _filtered_sql("li", "m") + """
, t AS (SELECT grid_id, avg(value) + 0.4 AS threshold FROM li GROUP BY grid_id), f AS (SELECT grid_id, "row", col FROM m JOIN t USING (grid_id) WHERE value > threshold)"""
       + _components_sql("f") + _DETECTED.format(n=4, m2="100.0::DOUBLE"), "stack db")
def detect_decline(spark, sf):
    return _run(detect.detect_lband(V.stack(spark, sf), ["HH", "VV"], offset=0.4, min_pixels=4, tile=TILE))


@query("detect_coherence", """
, sc AS (SELECT grid_id, "row", col, control - target AS value FROM layers)""" + _filtered_sql("sc", "m") + """
, t AS (SELECT grid_id, median(value) + 0.05 AS threshold FROM sc GROUP BY grid_id), f AS (SELECT grid_id, "row", col FROM m JOIN t USING (grid_id) WHERE value > threshold)"""
       + _components_sql("f") + _DETECTED.format(n=6, m2="6400.0::DOUBLE"), "layers")
def detect_coherence(spark, sf):
    return _run(detect.detect_coherence(V.coherence(spark, sf), offset=0.05, tile=TILE))


_CONTROL_20M = {"gt": [1003.0, 20.0, 0.0, 5997.0, 0.0, -20.0], "epsg": 32633, "width": 16, "height": 125}
_TARGET_10M = {"gt": [1000.0, 10.0, 0.0, 6000.0, 0.0, -10.0], "epsg": 32633, "width": 32, "height": 250}


def _grids(cells, grid):
    return cells.select("grid_id").distinct().select(
        "grid_id", F.lit(grid["width"]).alias("width"), F.lit(grid["height"]).alias("height"), F.array(*map(F.lit, grid["gt"])).alias("gt"),
        F.lit(grid["epsg"]).alias("epsg"), F.lit(None).cast("double").alias("nodata"),
    )


@query("detect_coherence_aligned", """
, ctl AS (SELECT grid_id, "row" // 2 AS r, col // 2 AS c, control AS v FROM layers WHERE "row" % 2 = 0 AND col % 2 = 0),
q AS (SELECT grid_id, "row", col, target, (5997 - (6000 - 10 * ("row" + 0.5::DOUBLE))) / 20 - 0.5::DOUBLE AS fr,
  (1000 + 10 * (col + 0.5::DOUBLE) - 1003) / 20 - 0.5::DOUBLE AS fc FROM layers),
n AS (SELECT q.*, floor(fr) + dr AS sr, floor(fc) + dc AS sc,
  CASE WHEN dr = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE WHEN dc = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS w
  FROM q, range(2) a(dr), range(2) b(dc)),
sc AS (SELECT n.grid_id, n."row", n.col, sum(w * v) / nullif(sum(w) FILTER (v IS NOT NULL), 0) - any_value(target) AS value
  FROM n LEFT JOIN ctl ON ctl.grid_id = n.grid_id AND ctl.r = n.sr AND ctl.c = n.sc GROUP BY n.grid_id, n."row", n.col)""" + _filtered_sql("sc", "m") + """
, t AS (SELECT grid_id, median(value) + 0.05 AS threshold FROM sc GROUP BY grid_id), f AS (SELECT grid_id, "row", col FROM m JOIN t USING (grid_id) WHERE value > threshold)"""
       + _components_sql("f") + """
, big AS (SELECT grid_id, label, count(*) AS n FROM lab GROUP BY ALL HAVING count(*) >= 6), runs AS (SELECT grid_id, sum(n)::BIGINT AS n_px FROM big GROUP BY grid_id)
SELECT grid_id, round(threshold, 6) AS threshold, coalesce(n_px, 0) AS n_px FROM t LEFT JOIN runs USING (grid_id)""", "layers")
def detect_coherence_aligned(spark, sf):
    """The control pair lies on cells of 20 m and is brought onto the target's 10 m; sizes in cells."""
    own = V.coherence(spark, sf)
    coarse = own.where("role = 'control' and row % 2 = 0 and col % 2 = 0").selectExpr("grid_id", "row div 2 as row", "col div 2 as col", "role", "value")
    both = own.where("role = 'target'").unionByName(coarse.withColumns({c: F.col(c).cast("int") for c in ("row", "col")}))
    d = detect.detect_coherence(both, offset=0.05, tile=TILE, grids=_grids(own, _TARGET_10M), control_grids=_grids(own, _CONTROL_20M))
    n = d.labelled.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_px"))
    return d.thresholds.select("grid_id", r6("threshold").alias("threshold")).join(n, "grid_id", "left").na.fill(0, ["n_px"])


_ANALYSIS, _BACKGROUND = "col >= 8", '"row" % 3 <> 0'


def _masks(spark, sf):
    cells = V.layers(spark, sf).select(*CELL)
    return {"analysis": cells.where("col >= 8"), "background": cells.where("row % 3 <> 0")}


def _coherence_sql(score: str, sample: str, inside: str) -> str:
    return f"""
, sc AS (SELECT grid_id, "row", col, {score} AS value FROM layers)""" + _filtered_sql("sc", "m") + f"""
, t AS (SELECT grid_id, median(value) + 0.05 AS threshold FROM sc WHERE {sample} GROUP BY grid_id),
f AS (SELECT grid_id, "row", col FROM m JOIN t USING (grid_id) WHERE value > threshold AND {inside})""" \
        + _components_sql("f") + _DETECTED.format(n=6, m2="6400.0::DOUBLE")


@query("detect_coherence_two_masks", _coherence_sql("control - target", f"{_ANALYSIS} AND {_BACKGROUND}", _ANALYSIS), "layers")
def detect_coherence_two_masks(spark, sf):
    return _run(detect.detect_coherence(V.coherence(spark, sf), offset=0.05, tile=TILE, **_masks(spark, sf)))


@query("detect_coherence_gain", _coherence_sql("target - control", f"{_ANALYSIS} AND {_BACKGROUND}", _ANALYSIS), "layers")
def detect_coherence_gain(spark, sf):
    return _run(detect.detect_coherence(V.coherence(spark, sf), mode="persistent_gain", offset=0.05, tile=TILE, **_masks(spark, sf)))


@query("detect_coherence_water", _coherence_sql("control - target", f"col % 5 <> 0 AND {_BACKGROUND}", "col % 5 <> 0"), "layers")
def detect_coherence_water(spark, sf):
    water = V.layers(spark, sf).select(*CELL, (F.col("col") % 5 != 0).cast("int").alias("value"))
    return _run(detect.detect_coherence(V.coherence(spark, sf), offset=0.05, tile=TILE, water=water, background=_masks(spark, sf)["background"]))


@query("detect_coherence_flooded", _coherence_sql("control - target", _ANALYSIS, _ANALYSIS), "layers")
def detect_coherence_flooded(spark, sf):
    """A water mask that covers more than half of the grid is not believed."""
    water = V.layers(spark, sf).select(*CELL, (F.col("col") % 5 == 0).cast("int").alias("value"))
    return _run(detect.detect_coherence(V.coherence(spark, sf), offset=0.05, tile=TILE, water=water, analysis=_masks(spark, sf)["analysis"]))


@query("safeguard_gain", f"""
SELECT grid_id, 'analysis' AS zone, round(avg(control) FILTER ({_ANALYSIS}), 4) AS coh_mean,
  round(count(*) FILTER ({_BACKGROUND}) / count(*), 4) AS forest_share, false AS flagged FROM layers GROUP BY grid_id""", "layers")
def safeguard_gain(spark, sf):
    d = detect.detect_coherence(V.coherence(spark, sf), mode="persistent_gain", offset=0.05, tile=TILE, **_masks(spark, sf))
    return d.extras["safeguard"].select("grid_id", "zone", "coh_mean", "forest_share", "flagged")


@query("medians_in_masks", f"""
SELECT grid_id, count(control - target) AS n_valid, round(median(target), 6) AS target_median, round(median(control), 6) AS control_median,
  round(median(control - target), 6) AS score_median FROM layers WHERE {_ANALYSIS} AND {_BACKGROUND} GROUP BY grid_id""", "layers")
def medians_in_masks(spark, sf):
    d = detect.detect_coherence(V.coherence(spark, sf), offset=0.05, tile=TILE, **_masks(spark, sf))
    return d.extras["medians"].select("grid_id", "n_valid", *[r6(c).alias(c) for c in ("target_median", "control_median", "score_median")])


@query("detected_outlines")
def detected_outlines(spark, sf):
    d = detect.detect_coherence(V.coherence(spark, sf), offset=0.05, tile=TILE)
    return objects.outlines(d.labelled, [500000.0, 80.0, 0.0, 5020000.0, 0.0, -80.0])


_SMALL = {"gt": [0.0, 10.0, 0.0, 200.0, 0.0, -10.0], "epsg": 32633, "width": 50, "height": 20}
_COARSE = {"gt": [0.0, 20.0, 0.0, 200.0, 0.0, -20.0], "epsg": 32633, "width": 25, "height": 10}


@query("annual_mask", """
, f AS (SELECT grid_id, "row" // 2 AS "row", col // 2 AS col, avg(CASE WHEN cover >= 30 AND (loss = 0 OR loss >= 17) THEN 1.0 ELSE 0.0 END) AS c,
  avg(CASE WHEN cover >= 30 AND (loss = 0 OR loss >= 18) THEN 1.0 ELSE 0.0 END) AS b FROM classes GROUP BY ALL)
SELECT 'candidate' AS mask, grid_id, "row", col FROM f WHERE c >= 0.5 UNION ALL SELECT 'background', grid_id, "row", col FROM f WHERE b >= 0.5""", "classes")
def annual_mask(spark, sf):
    a, b = forest.annual_masks(V.classes(spark, sf), 2017, _SMALL, _COARSE)
    return a.withColumn("mask", F.lit("candidate")).unionByName(b.withColumn("mask", F.lit("background")))


@query("class_forest", """
, g AS (SELECT DISTINCT grid_id FROM classes), t AS (SELECT grid_id, CAST(a AS INTEGER) AS "row", CAST(b AS INTEGER) AS col FROM g, range(10) p(a), range(25) q(b)),
d AS (SELECT t.grid_id, t."row", t.col, CASE WHEN cls IN (10, 20, 30, 40, 50) THEN 1 ELSE 0 END AS value FROM t LEFT JOIN classes c
  ON c.grid_id = t.grid_id AND c."row" = t."row" * 2 + 1 AND c.col = t.col * 2 + 1)""" + _window_sql("d", 1) + """
SELECT grid_id, "row", col FROM win GROUP BY grid_id, "row", col HAVING sum(v) * 2 > 9""", "classes")
def class_forest(spark, sf):
    return forest.class_mask(V.classes(spark, sf), _SMALL, _COARSE, (10, 20, 30, 40, 50), 3)


@query("mask_file", """
, g AS (SELECT DISTINCT grid_id FROM raw_field)
SELECT f.grid_id, CAST(a AS INTEGER) AS "row", CAST(b AS INTEGER) AS col FROM g, range(126) p(a), range(33) q(b), raw_field f
WHERE f.grid_id = g.grid_id AND f."row" = floor((2500 - (2496 - 20.0 * (a + 0.5))) / 10)::INTEGER AND f.col = floor((3 + 20.0 * (b + 0.5)) / 10)::INTEGER AND value > 0""", "raw_field")
def mask_file(spark, sf):
    return forest.mask_file(V.raw_field(spark, sf).select(*CELL, "value"), SOURCE, TARGET)


@query("backscatter_mask", """
, c AS (SELECT grid_id, "row", col, median(v) AS value FROM db WHERE band = 'VH' AND period = 'pre' GROUP BY ALL), l(lim) AS (VALUES (45.0::DOUBLE), (46.0::DOUBLE)),
grid AS (SELECT DISTINCT grid_id, "row", col FROM stack), d AS (SELECT lim, grid_id || '@' || CAST(lim AS VARCHAR) AS grid_id, "row", col, CASE WHEN value > lim THEN 1 ELSE 0 END AS value
  FROM grid LEFT JOIN c USING (grid_id, "row", col), l)""" + _window_sql("d", 1) + """
SELECT split_part(grid_id, '@', 1) AS grid_id, CAST(split_part(grid_id, '@', 2) AS DOUBLE) AS "limit", "row", col FROM win GROUP BY grid_id, "row", col HAVING sum(v) * 2 > 9""", "stack db")
def backscatter_mask(spark, sf):
    obs = stack.to_decibels(V.stack(spark, sf))
    pre = stack.median_composite(obs.where("band = 'VH' and period = 'pre'")).select(*CELL, "value")
    dense = obs.select(*CELL).distinct().join(pre, CELL, "left")
    return forest.backscatter_masks(settle(dense), (45.0, 46.0))


# -- evaluation ------------------------------------------------------------------------------------

_DID = """
, m AS (SELECT grid_id, 'pair' AS method, 1 - target AS score, label < 3 AS positive FROM layers WHERE target > 0 AND label <> 9
  UNION ALL SELECT grid_id, 'did', control - target, label < 3 FROM layers WHERE target > 0 AND control > 0 AND label <> 9)""" + _AUC.format(k="grid_id, method", t="m") + """
, q AS (SELECT grid_id, method, median(score) FILTER (positive) AS mr, median(score) FILTER (NOT positive) AS mb, quantile_cont(score, 0.95) FILTER (NOT positive) AS lim FROM m GROUP BY ALL)
SELECT grid_id, method, n_pos AS n_ref, n_neg AS n_bg, round(auc, 6) AS auc, round(mr - mb, 6) AS excess, round(count(*) FILTER (positive AND score >= lim) / n_pos, 6) AS tpr_at_fpr5
FROM m JOIN q USING (grid_id, method) JOIN a USING (grid_id, method) GROUP BY grid_id, method, n_pos, n_neg, auc, mr, mb, lim"""


@query("pair_and_did", _DID, "layers")
def pair_and_did(spark, sf):
    cells = V.layers(spark, sf)
    label = F.col("label")
    ref, ring, others = cells.where(label < 3), cells.where(label >= 0), cells.where(label == 9)
    p = experiments.pair_and_did(cells, ref, ring, others)
    return p.select("grid_id", "method", "n_ref", "n_bg", *[r6(c).alias(c) for c in ("auc", "excess", "tpr_at_fpr5")])


@query("rescore", _SENS + """
, mean AS (SELECT variant, avg(auc) AS m FROM f GROUP BY variant)
SELECT grid_id, variant, n_ref, n_bg, round(auc, 6) AS auc, round(m, 6) AS mean_auc FROM f JOIN mean USING (variant)""", "raw_field samples")
def rescore(spark, sf):
    label = F.col("label")
    per_event, mean = experiments.rescore(V.samples(spark, sf), {"v0": F.lit(True), "v1": label < 7, "v2": label < 0})
    return per_event.join(mean, "variant").select("grid_id", "variant", "n_ref", "n_bg", r6("auc").alias("auc"), r6("mean_auc").alias("mean_auc"))


_METRICS = """
, rs AS (SELECT v, grid_id, r.label, count(*) AS n, count(d.label) AS hit FROM (SELECT DISTINCT v FROM det) CROSS JOIN reflab r LEFT JOIN det d USING (v, grid_id, "row", col) GROUP BY ALL),
ds AS (SELECT v, grid_id, d.label, count(*) AS n, count(r.label) AS hit FROM det d LEFT JOIN reflab r USING (grid_id, "row", col) GROUP BY ALL),
a AS (SELECT v, grid_id, count(*) AS n_ref, count(*) FILTER (hit >= 0.3 * n) AS tp_ref FROM rs GROUP BY ALL),
b AS (SELECT v, grid_id, count(*) AS n_det, count(*) FILTER (hit >= 0.3 * n) AS tp_det FROM ds GROUP BY ALL)
SELECT {cols}, grid_id, n_ref, n_det, round(tp_ref / n_ref, 4) AS pa, round(tp_det / n_det, 4) AS ua FROM a JOIN b USING (v, grid_id)"""

_VARIANT_SQL = """
, di AS (SELECT 'pair' AS v, grid_id, "row", col, median(v) FILTER (band = 'VV' AND period = 'post') - median(v) FILTER (band = 'VV' AND period = 'pre')
    + median(v) FILTER (band = 'VH' AND period = 'post') - median(v) FILTER (band = 'VH' AND period = 'pre') AS value FROM db WHERE scene_id IN ('s0', 's1', 's2', 's3', 's4', 's5') GROUP BY grid_id, "row", col
  UNION ALL SELECT 'stack', grid_id, "row", col, value FROM wi UNION ALL SELECT 'stack_fixed', grid_id, "row", col, value FROM wi),
dj AS (SELECT v || '@' || grid_id AS grid_id, "row", col, value FROM di)""" + _filtered_sql("dj", "m") + """
, t AS (SELECT v || '@' || grid_id AS grid_id, CASE WHEN v = 'stack_fixed' THEN 0.8 ELSE avg(value) + 0.6 END AS threshold FROM di GROUP BY v, di.grid_id),
f AS (SELECT grid_id, "row", col FROM m JOIN t USING (grid_id) WHERE value > threshold),
ref AS (SELECT grid_id, "row", col FROM classes WHERE cover >= 60)""" + _components_sql("f") + _components_sql("ref", "ref") + """
, det AS (SELECT split_part(grid_id, '@', 1) AS v, split_part(grid_id, '@', 2) AS grid_id, "row", col, label FROM lab
  JOIN (SELECT grid_id, label FROM lab GROUP BY ALL HAVING count(*) >= 3) USING (grid_id, label))"""


@query("run_variants", _VARIANT_SQL + _METRICS.format(cols="v AS variant"), "stack db deltas wi classes")
def run_variants(spark, sf):
    obs = V.stack(spark, sf)
    few = F.col("scene_id").isin("s0", "s1", "s2", "s3", "s4", "s5")
    variants = {"pair": {"scenes": few, "offset": 0.6}, "stack": {"offset": 0.6}, "stack_fixed": {"mode": "fixed", "fixed": 0.8}}
    m = experiments.run_variants(obs, variants, V.classes(spark, sf).where("cover >= 60"), min_pixels=3, tile=TILE)
    return m.select("variant", "grid_id", "n_ref", "n_det", r6("pa", 4).alias("pa"), r6("ua", 4).alias("ua"))


_SCORES = _METRICS.split("SELECT {cols}")[0].rstrip() + """,
x AS (SELECT *, tp_ref / n_ref AS p, tp_det / n_det AS u FROM a JOIN b USING (v, grid_id))
SELECT {cols}, grid_id, round(threshold, 6) AS threshold, round(CASE WHEN p + u > 0 THEN 2 * p * u / (p + u) ELSE 0 END, 6) AS f1{more} FROM x JOIN {cuts}"""


@query("run_variants_scores", _VARIANT_SQL + _SCORES.format(
    cols="x.v AS variant", more=', round(area_ha, 6) AS area_ha',
    cuts="(SELECT split_part(grid_id, '@', 1) AS v, split_part(grid_id, '@', 2) AS grid_id, threshold FROM t) USING (v, grid_id) "
         "JOIN (SELECT v, grid_id, count(*) * 0.01::DOUBLE AS area_ha FROM det GROUP BY v, grid_id) USING (v, grid_id)",
), "stack db deltas wi classes")
def run_variants_scores(spark, sf):
    """Threshold, F1 and area of the variants."""
    few = F.col("scene_id").isin("s0", "s1", "s2", "s3", "s4", "s5")
    variants = {"pair": {"scenes": few, "offset": 0.6}, "stack": {"offset": 0.6}, "stack_fixed": {"mode": "fixed", "fixed": 0.8}}
    m = experiments.run_variants(V.stack(spark, sf), variants, V.classes(spark, sf).where("cover >= 60"), min_pixels=3, tile=TILE)
    return m.select("variant", "grid_id", r6("threshold").alias("threshold"), r6("f1").alias("f1"), r6("area_ha").alias("area_ha"))


@query("mask_effect_scores", _filtered_sql("wi", "m") + """
, masks AS (SELECT 'none' AS v, grid_id, "row", col FROM classes UNION ALL SELECT 'forest', grid_id, "row", col FROM classes WHERE cover >= 30
  UNION ALL SELECT 'west', grid_id, "row", col FROM classes WHERE col < 25),
t AS (SELECT v, grid_id, avg(value) + 0.6 AS threshold FROM wi JOIN masks USING (grid_id, "row", col) GROUP BY ALL),
f AS (SELECT v || '@' || grid_id AS grid_id, "row", col FROM m JOIN masks USING (grid_id, "row", col) JOIN t USING (v, grid_id) WHERE value > threshold),
ref AS (SELECT grid_id, "row", col FROM classes WHERE cover >= 60)""" + _components_sql("f") + _components_sql("ref", "ref") + """
, det AS (SELECT split_part(grid_id, '@', 1) AS v, split_part(grid_id, '@', 2) AS grid_id, "row", col, label FROM lab
  JOIN (SELECT grid_id, label FROM lab GROUP BY ALL HAVING count(*) >= 2) USING (grid_id, label))""" + _SCORES.format(cols="x.v AS mask", more="", cuts="t USING (v, grid_id)"),
       "stack db deltas wi classes")
def mask_effect_scores(spark, sf):
    """Threshold and F1 under three masks that overlap."""
    index, _ = detect.amplitude_index(V.stack(spark, sf), ["VV", "VH"])
    cells = V.classes(spark, sf)
    m = experiments.mask_effect(index, {"none": None, "forest": cells.where("cover >= 30"), "west": cells.where("col < 25")}, cells.where("cover >= 60"), 2, 0.6, TILE)
    return m.select("mask", "grid_id", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query("mask_effect", _filtered_sql("wi", "m") + """
, masks AS (SELECT 'none' AS v, grid_id, "row", col FROM classes UNION ALL SELECT 'forest', grid_id, "row", col FROM classes WHERE cover >= 30),
t AS (SELECT v, grid_id, avg(value) + 0.6 AS threshold FROM wi JOIN masks USING (grid_id, "row", col) GROUP BY ALL),
f AS (SELECT v || '@' || grid_id AS grid_id, "row", col FROM m JOIN masks USING (grid_id, "row", col) JOIN t USING (v, grid_id) WHERE value > threshold),
ref AS (SELECT grid_id, "row", col FROM classes WHERE cover >= 60)""" + _components_sql("f") + _components_sql("ref", "ref") + """
, det AS (SELECT split_part(grid_id, '@', 1) AS v, split_part(grid_id, '@', 2) AS grid_id, "row", col, label FROM lab
  JOIN (SELECT grid_id, label FROM lab GROUP BY ALL HAVING count(*) >= 2) USING (grid_id, label))""" + _METRICS.format(cols="v AS mask"), "stack db deltas wi classes")
def mask_effect(spark, sf):
    index, _ = detect.amplitude_index(V.stack(spark, sf), ["VV", "VH"])
    cells = V.classes(spark, sf)
    m = experiments.mask_effect(index, {"none": None, "forest": cells.where("cover >= 30")}, cells.where("cover >= 60"), 2, 0.6, TILE)
    return m.select("mask", "grid_id", "n_ref", "n_det", r6("pa", 4).alias("pa"), r6("ua", 4).alias("ua"))


@query("index_detections")
def index_detections(spark, sf):
    cells = settle(stack.deltas(stack.to_decibels(V.stack(spark, sf)), ["VV", "VH"]))
    family = settle(stack.index_family(cells))
    classes = V.classes(spark, sf)
    ref, bg = classes.where("cover >= 60"), classes.where("cover < 60")
    samples = settle(experiments.study_samples(family, ref, bg))
    m = experiments.index_detections(family, ref, samples, 0.6, 3, TILE)
    return m.select("grid_id", "index", "mode", r6("threshold").alias("threshold"), "n_ref", "n_det", r6("pa", 4).alias("pa"), r6("ua", 4).alias("ua"))


@query("forest_statistics", """
, c AS (SELECT grid_id AS event_id, 2016 + CAST(substr(grid_id, 2) AS INTEGER) % 3 AS y, CASE WHEN col < 35 THEN 'poly' ELSE 'ring' END AS zone, cover, loss FROM classes),
s AS (SELECT event_id, round(avg(CASE WHEN cover >= 30 AND (loss = 0 OR loss >= y - 2000) THEN 1.0 ELSE 0.0 END) FILTER (zone = 'poly'), 4) AS forest_cand_frac,
  round(avg(CASE WHEN cover >= 30 AND (loss = 0 OR loss >= y - 1999) THEN 1.0 ELSE 0.0 END) FILTER (zone = 'poly'), 4) AS forest_bg_frac,
  round(avg(CASE WHEN cover >= 30 AND loss = y - 2000 THEN 1.0 ELSE 0.0 END) FILTER (zone = 'poly'), 4) AS loss_in_year_frac,
  round(avg(CASE WHEN cover >= 30 AND (loss = 0 OR loss >= y - 2000) THEN 1.0 ELSE 0.0 END) FILTER (zone = 'ring'), 4) AS ring_forest_cand_frac,
  round(avg(CASE WHEN cover >= 20 AND (loss = 0 OR loss >= y - 2000) THEN 1.0 ELSE 0.0 END) FILTER (zone = 'poly'), 4) AS forest_cand_frac_tau20,
  round(avg(CASE WHEN cover >= 50 AND (loss = 0 OR loss >= y - 2000) THEN 1.0 ELSE 0.0 END) FILTER (zone = 'poly'), 4) AS forest_cand_frac_tau50,
  round(median(cover) FILTER (zone = 'poly'), 1) AS cover_median FROM c GROUP BY event_id)
SELECT *, forest_cand_frac AS forest_cand_frac_tau30, forest_cand_frac < 0.30 AS outside_forest FROM s""", "classes")
def forest_statistics(spark, sf):
    g = F.substring("grid_id", 2, 10).cast("int")
    cells = V.classes(spark, sf).select(
        F.col("grid_id").alias("event_id"), (g % 3 + 2016).alias("year"), F.when(F.col("col") < 35, "poly").otherwise("ring").alias("zone"), "cover", "loss"
    )
    return screening.forest_statistics(cells).withColumn("cover_median", r6("cover_median", 1))


@query("masked_threshold", """
, b AS (SELECT grid_id, avg(value) AS c FROM wi JOIN classes USING (grid_id, "row", col) WHERE cover >= 30 AND (loss = 0 OR loss >= 18) GROUP BY grid_id)
SELECT grid_id, "row", col, round(value - (c + 1.5), 6) AS over FROM wi JOIN b USING (grid_id) WHERE value > c + 1.5""".replace("AS over", "AS excess"), "stack db deltas wi classes")
def masked_threshold(spark, sf):
    from deltacell.functions import radiometry as R

    index, _ = detect.amplitude_index(V.stack(spark, sf), ["VV", "VH"])
    bg = V.classes(spark, sf).where(R.forest_background(F.col("cover"), F.col("loss"), 2017))
    t = stack.mean_threshold(stack.statistics_sample(index, bg), 1.5)
    over = attach(index, t, ["grid_id"]).where(F.col("value") > F.col("threshold"))
    return over.select(*CELL, r6(F.col("value") - F.col("threshold")).alias("excess"))


# -- sites -----------------------------------------------------------------------------------------

@query("merge_status", """
WITH s AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'processed' WHEN 1 THEN 'shortlisted' ELSE 'candidate' END AS status FROM customer),
r AS (SELECT o_custkey AS id, max(o_totalprice) AS auc FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT id, CASE WHEN status = 'shortlisted' AND auc IS NOT NULL THEN 'processed' WHEN status = 'shortlisted' AND id % 2 = 0 THEN 'reserve' ELSE status END AS status,
  CASE WHEN status = 'shortlisted' THEN auc END AS auc FROM s LEFT JOIN r USING (id)
UNION ALL SELECT s_suppkey + 10000000, 'processed', NULL FROM supplier""")
def merge_status(spark, sf):
    k = F.col("c_custkey")
    sites = V.table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, "processed").when(k % 3 == 1, "shortlisted").otherwise("candidate").alias("status"))
    results = V.table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("auc"))
    added = V.table(spark, sf, "supplier").select((F.col("s_suppkey") + 10000000).alias("id"), F.lit("processed").alias("status"))
    merged = sinks.merge_status(sites, results, sites.where("id % 2 = 0"), added)
    return merged.select("id", "status", F.col("result.auc").alias("auc"))


@query("site_features")
def site_features(spark, sf):
    return sinks.site_features(V.diamonds(spark, sf))


@query("run_report", """
SELECT grid_id, round(avg(value), 6) AS mean, 'candidate_map_unvalidated' AS status, '2.9' AS offset_db FROM wi GROUP BY grid_id""", "stack db deltas wi")
def run_report(spark, sf):
    index, _ = detect.amplitude_index(V.stack(spark, sf), ["VV", "VH"])
    m = index.groupBy("grid_id").agg(r6(F.avg("value")).alias("mean"))
    r = sinks.run_report(m, {"offset_db": 2.9, "mode": "adaptive"})
    return r.select("grid_id", "mean", "status", F.col("parameters")["offset_db"].alias("offset_db"))


@query("site_funnel")
def site_funnel(spark, sf):
    """Candidates from orders, granules from events, landscape from customers, end to end."""
    from deltacell.functions import geometry as G

    k = F.col("id")
    day = F.date_add(F.lit("2017-05-01").cast("date"), (k * 11 % 150).cast("int"))
    x, y = (k % 50).cast("double"), (k % 30).cast("double")
    events = V.catalogue(spark, sf).select(
        k, "type", "certainty", "year", F.date_format(day, "yyyy/MM/dd").alias("date_1"), "area_km2", "mean_width_m", "wind_gust",
        F.array(G.box_ring(x, y, x + 1, y + 1)).alias("geom"),
    )
    u = F.col("user_id")
    start = 1704067200000000
    ts = F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) - start) * 8 + 1491004800000000)
    gx, gy = (u * 7 % 46).cast("double"), (u * 5 % 26).cast("double")
    ring = G.box_ring(gx, gy, gx + 4.5, gy + 4.5)
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    granules = V.table(spark, sf, "events").select(
        F.concat(F.lit("S1A_IW_SLC__"), F.col("event_id").cast("string")).alias("title"), ts.alias("ts"), F.col("event_type").alias("platform"),
        F.lit("IW").alias("mode"), (u % 175).cast("int").alias("orbit_key"), F.struct(ring.alias("as_given"), none.alias("swapped")).alias("rings"),
        (u % 175).cast("string").alias("track_key"),
    )
    land = V.catalogue(spark, sf).select(
        P.event_key(k, F.date_format(day, "yyyy/MM/dd")).alias("event_id"), "forest_frac", "water_frac", "slope_mean_deg"
    )
    parts = P.site_funnel(events, granules, land)
    return parts["top"].select("event_id", "type", "score", "quality", "pre", "post", "control")


@query("compare_databases", """
, c AS (SELECT a.id, b.area_km2 / nullif(a.area_km2, 0) AS r FROM catalogue a LEFT JOIN catalogue b ON b.id = a.id + 1)
SELECT count(r) AS "count", round(avg(r), 5) AS mean, round(median(r), 5) AS p50, round(max(r), 5) AS "max" FROM c""", "catalogue")
def compare_databases(spark, sf):
    e = V.catalogue(spark, sf)
    parts = P.compare_databases(e, e.withColumn("id", F.col("id") - 1))
    return parts["ratio"].select("count", *[r6(c, 5).alias(c) for c in ("mean", "p50", "max")])
