"""Per-cell values, statistics, masks, filters and reference scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query, r6
from deltacell import schema as S
from deltacell.functions import radiometry as R
from deltacell.operators import evaluate as E
from deltacell.operators import focal, masks, order, stack
from deltacell.operators.joins import attach
from deltacell.session import settle

CELL = ["grid_id", "row", "col"]


def _db(spark, sf):
    return stack.to_decibels(V.stack(spark, sf))


def _deltas(spark, sf, bands=("VV", "VH")):
    return stack.deltas(_db(spark, sf), list(bands))


def _wi(spark, sf):
    return stack.change_index(_deltas(spark, sf), ["VV", "VH"])


# -- conversions -------------------------------------------------------------------------------

@query("db_roundtrip", """
SELECT grid_id, scene_id, band, count(v) AS n, round(sum(v), 4) AS sum_db, round(sum(pow(10, v / 10)), 3) AS sum_back
FROM db GROUP BY ALL""", "stack db")
def db_roundtrip(spark, sf):
    db = R.to_db(F.col("value"))
    cells = V.stack(spark, sf).withColumn("v", db)
    return cells.groupBy("grid_id", "scene_id", "band").agg(
        F.count("v").alias("n"), r6(F.sum("v"), 4).alias("sum_db"), r6(F.sum(R.from_db(F.col("v"))), 3).alias("sum_back")
    )


@query("db_domain_flag", """
, layered AS (SELECT grid_id, 'stack' AS layer, value FROM stack UNION ALL SELECT grid_id, 'field', value FROM field)
SELECT grid_id, layer, round(count(*) FILTER (value < 0 AND value > -100) / count(value), 6) AS share,
  count(*) FILTER (value < 0 AND value > -100) / count(value) > 0.05 AS already_db
FROM layered GROUP BY ALL""", "stack raw_field field")
def db_domain_flag(spark, sf):
    a = V.stack(spark, sf).select("grid_id", F.lit("stack").alias("layer"), "value")
    b = V.field(spark, sf).select("grid_id", F.lit("field").alias("layer"), "value")
    v = F.col("value")
    return a.unionByName(b).groupBy("grid_id", "layer").agg(
        r6(R.negative_share(v)).alias("share"), R.is_db(v).alias("already_db")
    )


@query("db_convert", """
, f AS (SELECT grid_id, "row", 'v' AS k, value FROM field)
SELECT f.grid_id, f."row", count(x) AS n, round(sum(x), 6) AS total FROM (
  SELECT f.grid_id, f."row", CASE WHEN is_db THEN CASE WHEN value > -100 THEN value END
    WHEN value > 0 THEN 10 * log10(value) END AS x
  FROM f JOIN (SELECT grid_id, "row", coalesce(count(*) FILTER (value < 0 AND value > -100) / nullif(count(value), 0) > 0.05, false)
    AS is_db FROM f GROUP BY ALL) USING (grid_id, "row")) f GROUP BY ALL""", "raw_field field")
def db_convert(spark, sf):
    rows = V.field(spark, sf).withColumn("scene_id", F.col("row").cast("string")).withColumn("band", F.lit("v"))
    return stack.to_decibels(rows).groupBy("grid_id", "row").agg(F.count("db").alias("n"), r6(F.sum("db")).alias("total"))


@query("land_mask", """
SELECT grid_id, "row", col, bool_or(coalesce(v < 40, false)) AS water FROM db GROUP BY ALL""", "stack db")
def land_mask(spark, sf):
    bands = _db(spark, sf).select(*CELL, F.col("db").alias("value"))
    return focal.land_cells(bands, 40.0)


@query("class_mask", 'SELECT grid_id, "row", col FROM classes WHERE cls IN (10, 90)', "classes")
def class_mask(spark, sf):
    return masks.from_predicate(V.classes(spark, sf), R.in_classes(F.col("cls"), (10, 90)))


_FOREST = """
, y AS (SELECT unnest([2000, 2010, 2017]) AS year)
SELECT year, grid_id, count(*) AS n, sum("row" * 50 + col)::BIGINT AS code FROM classes, y
WHERE cover >= 30 AND (year <= 2000 OR loss = 0 OR loss >= year - 2000{plus}) GROUP BY ALL"""


def _forest(spark, sf, rule):
    years = F.explode(F.array(*[F.lit(y) for y in (2000, 2010, 2017)]))
    cells = V.classes(spark, sf).withColumn("year", years)
    kept = cells.where(rule(F.col("cover"), F.col("loss"), F.col("year")))
    return kept.groupBy("year", "grid_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("row") * 50 + F.col("col")).cast("bigint")).alias("code")
    )


@query("forest_candidate", _FOREST.format(plus=""), "classes")
def forest_candidate(spark, sf):
    return _forest(spark, sf, R.forest_candidate)


@query("forest_background", _FOREST.format(plus=" + 1"), "classes")
def forest_background(spark, sf):
    return _forest(spark, sf, R.forest_background)


@query("loss_in_year_by_tau", """
, t AS (SELECT unnest([20, 30, 50]) AS tau)
SELECT grid_id, tau, count(*) FILTER (loss = 17 AND cover >= tau) AS n, count(*) AS total FROM classes, t GROUP BY ALL""", "classes")
def loss_in_year_by_tau(spark, sf):
    taus = F.explode(F.array(*[F.lit(t) for t in S.COVER_TAUS]))
    cells = V.classes(spark, sf).withColumn("tau", taus)
    hit = R.loss_in_year(F.col("cover"), F.col("loss"), 2017, F.col("tau"))
    return cells.groupBy("grid_id", "tau").agg(F.count_if(hit).alias("n"), F.count(F.lit(1)).alias("total"))


@query("cross_pol_forest", """
, c AS (SELECT grid_id, "row", col, median(v) AS value FROM db WHERE band = 'VH' AND period = 'pre' GROUP BY ALL),
t AS (SELECT unnest([45.0, 46.0, 47.0])::DOUBLE AS lim)
SELECT grid_id, lim, count(*) AS n FROM c, t WHERE value > lim GROUP BY ALL""", "stack db")
def cross_pol_forest(spark, sf):
    pre = _db(spark, sf).where("band = 'VH' and period = 'pre'")
    lim = F.explode(F.array(*[F.lit(v) for v in (45.0, 46.0, 47.0)]))
    return stack.median_composite(pre).withColumn("lim", lim).where(F.col("value") > F.col("lim")).groupBy(
        "grid_id", "lim"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("sentinel_clean", """
SELECT grid_id, count(*) AS n, count(x) AS known, round(sum(x), 6) AS total FROM (
  SELECT grid_id, CASE WHEN v = 0.1 OR v = -0.1 THEN NULL ELSE v END AS x FROM (SELECT grid_id, round(value, 1) AS v FROM raw_field))
GROUP BY ALL""", "raw_field")
def sentinel_clean(spark, sf):
    rounded = V.raw_field(spark, sf).select("grid_id", F.round("value", 1).alias("v"))
    x = rounded.select("grid_id", R.clean(F.col("v"), 0.1, -0.1).alias("x"))
    return x.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("known"), r6(F.sum("x")).alias("total"))


# -- stacks and indices ------------------------------------------------------------------------

@query("median_composite", """
SELECT grid_id, period, band, "row", col, round(median(v), 6) AS value FROM db GROUP BY ALL""", "stack db")
def median_composite(spark, sf):
    return stack.median_composite(_db(spark, sf)).withColumn("value", r6("value"))


@query("wi_minimum", """
, t AS (SELECT grid_id, avg(value) + 2.9 AS threshold FROM wi GROUP BY grid_id)
SELECT grid_id, "row", col, round(value, 6) AS value, round(threshold, 6) AS threshold
FROM wi JOIN t USING (grid_id) WHERE value > threshold""", "stack db deltas wi")
def wi_minimum(spark, sf):
    index = settle(_wi(spark, sf))
    flagged = stack.flag_above(index, stack.mean_threshold(index))
    return flagged.select(*CELL, r6("value").alias("value"), r6("threshold").alias("threshold"))


@query("decline_index", """
, h AS (SELECT grid_id, "row", col, median(v) FILTER (period = 'post') - median(v) FILTER (period = 'pre') AS d
  FROM db WHERE band = 'HH' GROUP BY ALL)
SELECT grid_id, "row", col, round(-d, 6) AS value FROM h""", "stack db")
def decline_index(spark, sf):
    return stack.change_index(_deltas(spark, sf, ["HH"]), ["HH"], -1.0).select(*CELL, r6("value").alias("value"))


@query("common_bands", """
, b AS (SELECT grid_id, band FROM stack GROUP BY ALL HAVING count(DISTINCT period) = 2)
SELECT grid_id, string_agg(band, ',' ORDER BY CASE band WHEN 'VV' THEN 1 WHEN 'VH' THEN 2 ELSE 99 END, band) AS bands
FROM b GROUP BY grid_id""", "stack")
def common_bands(spark, sf):
    return stack.common_bands(V.stack(spark, sf)).select("grid_id", F.array_join("bands", ",").alias("bands"))


@query("background_offset", """
SELECT grid_id, round(coalesce(median(d_VV), 0), 6) AS o_VV, round(coalesce(median(d_VH), 0), 6) AS o_VH
FROM deltas GROUP BY grid_id""", "stack db deltas")
def background_offset(spark, sf):
    cells = settle(_deltas(spark, sf))
    return stack.band_offsets(cells, ["VV", "VH"]).select("grid_id", r6("o_VV").alias("o_VV"), r6("o_VH").alias("o_VH"))


@query("normalized_index", """
, bg AS (SELECT * FROM deltas WHERE col < 15),
o AS (SELECT grid_id, coalesce(median(d_VV), 0) AS a, coalesce(median(d_VH), 0) AS b FROM bg GROUP BY grid_id)
SELECT grid_id, "row", col, round((d_VV - a) + (d_VH - b), 6) AS value FROM deltas JOIN o USING (grid_id)""", "stack db deltas")
def normalized_index(spark, sf):
    cells = settle(_deltas(spark, sf))
    offsets = stack.band_offsets(cells, ["VV", "VH"], cells.where("col < 15"))
    return stack.change_index(stack.remove_offsets(cells, ["VV", "VH"], offsets), ["VV", "VH"]).select(
        *CELL, r6("value").alias("value")
    )


@query("threshold_adaptive_mean", """
SELECT grid_id, round(avg(value), 6) AS center, round(avg(value) + 2.9, 6) AS threshold FROM wi WHERE col < 15
GROUP BY grid_id""", "stack db deltas wi")
def threshold_adaptive_mean(spark, sf):
    index = _wi(spark, sf)
    t = stack.mean_threshold(stack.statistics_sample(index, index.where("col < 15"), None))
    return t.select("grid_id", r6("center").alias("center"), r6("threshold").alias("threshold"))


@query("threshold_adaptive_median", """
SELECT grid_id, round(median(control - target), 6) AS center, round(median(control - target) + 0.25, 6) AS threshold
FROM layers GROUP BY grid_id""", "layers")
def threshold_adaptive_median(spark, sf):
    t = stack.median_threshold(stack.score_cells(V.layers(spark, sf)))
    return t.select("grid_id", r6("center").alias("center"), r6("threshold").alias("threshold"))


@query("threshold_fixed", """
SELECT grid_id, "row", col, round(value, 6) AS value FROM wi WHERE value > 3.0""", "stack db deltas wi")
def threshold_fixed(spark, sf):
    return _wi(spark, sf).where(R.above(F.col("value"), S.AMPLITUDE_FIXED_DB)).select(*CELL, r6("value").alias("value"))


_WEIGHTS = ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in S.INDEX_WEIGHTS.items())


@query("index_family", f"""
, w(name, a, b) AS (VALUES {_WEIGHTS})
SELECT grid_id, name AS "index", count(d_VV + d_VH) AS n, round(avg(a * d_VV + b * d_VH), 6) AS mean,
  round(median(CAST(a AS DOUBLE) * d_VV + CAST(b AS DOUBLE) * d_VH), 6) AS med FROM deltas, w GROUP BY ALL""", "stack db deltas")
def index_family(spark, sf):
    rows = settle(stack.index_family(_deltas(spark, sf)))
    keys = ["grid_id", "index"]
    med = order.quantiles(rows, keys, "value", {"med": 0.5})
    return med.join(rows.groupBy(*keys).agg(F.avg("value").alias("mean")), keys).select(
        *keys, "n", r6("mean").alias("mean"), r6("med").alias("med")
    )


# -- coherence ---------------------------------------------------------------------------------

def _scored(spark, sf, mode, control=True):
    cells = stack.coherence_layers(V.coherence(spark, sf))
    return stack.score_cells(cells, mode, control).select(*CELL, r6("value").alias("value"))


@query("coherence_score_drop", 'SELECT grid_id, "row", col, round(control - target, 6) AS value FROM layers', "layers")
def coherence_score_drop(spark, sf):
    return _scored(spark, sf, "event_drop")


@query("coherence_score_gain", 'SELECT grid_id, "row", col, round(target - control, 6) AS value FROM layers', "layers")
def coherence_score_gain(spark, sf):
    return _scored(spark, sf, "persistent_gain")


@query("coherence_static", 'SELECT grid_id, "row", col, round(1 - target, 6) AS value FROM layers', "layers")
def coherence_static(spark, sf):
    return _scored(spark, sf, "event_drop", False)


@query("coherence_sanitize", """
SELECT grid_id, count(*) AS n, count(*) FILTER (target * 2 BETWEEN -0.01 AND 1.01) AS valid FROM layers GROUP BY grid_id""", "layers")
def coherence_sanitize(spark, sf):
    v = R.sane_coherence(F.col("target") * 2)
    return V.layers(spark, sf).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("valid"))


@query("coherence_validity", """
, s AS (SELECT grid_id, target * 2 - 1 AS t, control * 2 - 1 AS c FROM layers)
SELECT grid_id, count(*) FILTER (t > 0) AS pair, count(*) FILTER (t IS NOT NULL AND c IS NOT NULL) AS finite,
  count(*) FILTER (t > 0 AND c > 0) AS both_positive, count(*) FILTER (t > 0 AND t < 1) AS open_unit
FROM s GROUP BY grid_id""", "layers")
def coherence_validity(spark, sf):
    t, c = F.col("target") * 2 - 1, F.col("control") * 2 - 1
    rules = ("pair", "finite", "both_positive", "open_unit")
    return V.layers(spark, sf).groupBy("grid_id").agg(
        *[F.count_if(R.valid_coherence(t, c, r)).alias(r) for r in rules]
    )


# -- statistics --------------------------------------------------------------------------------

@query("band_stats", """
SELECT grid_id, band, round(min(v), 6) AS "min", round(max(v), 6) AS "max", round(avg(v), 6) AS mean,
  round(stddev_pop(v), 6) AS std FROM db GROUP BY ALL""", "stack db")
def band_stats(spark, sf):
    s = E.band_stats(_db(spark, sf), ["grid_id", "band"], "db")
    return s.select("grid_id", "band", *[r6(c).alias(c) for c in ("min", "max", "mean", "std")])


@query("block_stats", """
SELECT grid_id, label, count(target) AS n, round(median(target), 4) AS median, round(avg(target), 4) AS mean,
  round(quantile_cont(target, 0.25), 4) AS p25, round(quantile_cont(target, 0.75), 4) AS p75 FROM layers GROUP BY ALL""", "layers")
def block_stats(spark, sf):
    s = E.block_stats(V.layers(spark, sf), ["grid_id", "label"], "target")
    return s.select("grid_id", "label", "n", *[r6(c, 4).alias(c) for c in ("median", "mean", "p25", "p75")])


@query("water_fraction", """
SELECT grid_id, round(avg(CASE WHEN loss = 0 THEN 1.0 ELSE 0.0 END), 6) AS water_fraction,
  avg(CASE WHEN loss = 0 THEN 1.0 ELSE 0.0 END) <= 0.5 AS usable FROM classes GROUP BY grid_id""", "classes")
def water_fraction(spark, sf):
    cells = V.classes(spark, sf).withColumn("value", F.col("loss"))
    w = E.water_fraction(cells, ["grid_id"], 0)
    return w.withColumn("water_fraction", r6("water_fraction"))


@query("usable_land", 'SELECT grid_id, "row", col FROM classes WHERE cover > 20', "classes")
def usable_land(spark, sf):
    cells = V.classes(spark, sf).withColumn("value", (F.col("cover") > 20).cast("int"))
    return E.usable_land(cells, ["grid_id"]).where(R.is_land(F.col("value"))).select(*CELL)


@query("safeguard", """
, z AS (SELECT grid_id, round(avg(target), 4) AS coh_mean, avg(target) > 0.6 AS high FROM layers WHERE label >= 2 GROUP BY grid_id),
s AS (SELECT grid_id, count(*) FILTER (label >= 2) / count(*) AS share FROM layers GROUP BY grid_id)
SELECT grid_id, 'analysis' AS zone, coh_mean, round(share, 4) AS forest_share, high OR share < 0.3 AS flagged,
  concat_ws(',', CASE WHEN high THEN 'high_coherence' END, CASE WHEN share < 0.3 THEN 'low_forest_share' END) AS reasons
FROM z JOIN s USING (grid_id)""", "layers")
def safeguard(spark, sf):
    cells = V.layers(spark, sf)
    zone = cells.where("label >= 2")
    share = cells.groupBy("grid_id").agg((F.count_if(F.col("label") >= 2) / F.count(F.lit(1))).alias("forest_share"))
    s = E.safeguard(zone, share, "event_drop", "analysis")
    return s.select("grid_id", "zone", "coh_mean", "forest_share", "flagged", F.array_join("reasons", ",").alias("reasons"))


@query("layer_medians", """
SELECT grid_id, count(control - target) AS n_valid, round(median(target), 6) AS target_median,
  round(median(control), 6) AS control_median, round(median(control - target), 6) AS score_median,
  abs(median(control - target)) < 0.05 AS near_floor FROM layers GROUP BY grid_id""", "layers")
def layer_medians(spark, sf):
    m = E.layer_medians(stack.score_cells(V.layers(spark, sf)))
    return m.select("grid_id", "n_valid", "near_floor", *[
        r6(c).alias(c) for c in ("target_median", "control_median", "score_median")
    ])


@query("zone_diagnosis", """
, long AS (SELECT grid_id, label < 3 AS ref, 'prepost' AS pair, target AS v FROM layers
  UNION ALL SELECT grid_id, label < 3, 'control', control FROM layers)
SELECT grid_id, ref, pair, count(v) AS n, round(median(v), 6) AS median FROM long GROUP BY ALL""", "layers")
def zone_diagnosis(spark, sf):
    pair = lambda n, c: F.struct(F.lit(n).alias("pair"), F.col(c).alias("v"))
    long = V.layers(spark, sf).select(
        "grid_id", (F.col("label") < 3).alias("ref"), F.explode(F.array(pair("prepost", "target"), pair("control", "control"))).alias("_p")
    ).select("grid_id", "ref", "_p.*")
    return E.zone_medians(long, ["grid_id", "ref", "pair"], "v").withColumn("median", r6("median"))


@query("share_above", """
, m AS (SELECT grid_id, median(value) AS med FROM raw_field WHERE label >= 3 GROUP BY grid_id)
SELECT grid_id, round(avg(CASE WHEN value > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS over_01,
  round(avg(CASE WHEN value > med + 0.15 THEN 1.0 ELSE 0.0 END), 6) AS over_bg
FROM raw_field JOIN m USING (grid_id) WHERE label < 3 GROUP BY grid_id""", "raw_field")
def share_above(spark, sf):
    cells = V.raw_field(spark, sf)
    med = order.quantiles(cells.where("label >= 3"), ["grid_id"], "value", {"med": 0.5}).select("grid_id", "med")
    ref = attach(cells.where("label < 3"), med, ["grid_id"])
    s = E.share_above(ref, ["grid_id"], {"over_01": 0.1, "over_bg": F.col("med") + 0.15})
    return s.select("grid_id", r6("over_01").alias("over_01"), r6("over_bg").alias("over_bg"))


@query("dark_ring", """
, q AS (SELECT grid_id, quantile_cont(value, 0.40) AS lim FROM raw_field WHERE label >= 3 GROUP BY grid_id)
SELECT grid_id, "row", col FROM raw_field JOIN q USING (grid_id) WHERE label >= 3 AND value < lim""", "raw_field")
def dark_ring(spark, sf):
    return E.dark_ring(V.raw_field(spark, sf).where("label >= 3"), ["grid_id"]).select(*CELL)


@query("detected_area", """
SELECT grid_id, count(*) AS n_px, round(count(*) * 100.0 / 1e4, 6) AS area_ha FROM raw_field WHERE value > 0.15 GROUP BY grid_id""", "raw_field")
def detected_area(spark, sf):
    a = E.detected_area(V.raw_field(spark, sf).where("value > 0.15"), ["grid_id"], 100.0)
    return a.withColumn("area_ha", r6("area_ha"))


@query("mask_coverage", """
, c AS (SELECT grid_id, value > 0.1 AS ref, value > 0 AS wide, abs(value) < 0.1 AS narrow FROM raw_field),
l AS (SELECT grid_id, ref, unnest(['wide', 'narrow']) AS mask, unnest([wide, narrow]) AS m FROM c)
SELECT grid_id, mask, round(avg(CASE WHEN m THEN 1.0 ELSE 0.0 END), 6) AS share,
  round(count(*) FILTER (m) * 0.01::DOUBLE, 6) AS area_ha, round(count(*) FILTER (m AND ref) / greatest(1, count(*) FILTER (ref)), 6) AS ref_coverage
FROM l GROUP BY ALL""", "raw_field")
def mask_coverage(spark, sf):
    v = F.col("value")
    cells = V.raw_field(spark, sf).select("grid_id", (v > 0.1).alias("ref"), (v > 0).alias("wide"), (F.abs(v) < 0.1).alias("narrow"))
    m = E.mask_coverage(cells, ["grid_id"], ["wide", "narrow"], "ref", 0.01)
    return m.select("grid_id", "mask", *[r6(c).alias(c) for c in ("share", "area_ha", "ref_coverage")])


# -- reference scores ----------------------------------------------------------------------------

_AUC = """
, d AS (SELECT {k}, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM {t} GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY score) - n AS below FROM d),
a AS (SELECT {k}, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg,
  sum(p::DOUBLE * (below + n / 2)) / nullif(sum(p)::DOUBLE * sum(n), 0) AS auc FROM c GROUP BY ALL)"""


@query("auc", """
, s AS (SELECT event_type AS grid_id, value AS score, user_id % 2 = 0 AS positive FROM events)""" .replace(", s", "WITH s", 1)
       + _AUC.format(k="grid_id", t="s") + """
SELECT grid_id, n_pos, n_neg, round(auc, 6) AS auc FROM a""")
def auc(spark, sf):
    s = V.table(spark, sf, "events").select(
        F.col("event_type").alias("grid_id"), F.col("value").alias("score"), (F.col("user_id") % 2 == 0).alias("positive")
    )
    return E.rank_auc(E.score_curve(s, ["grid_id"]), ["grid_id"]).withColumn("auc", r6("auc"))


@query("youden_le", """
, d AS (SELECT grid_id, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM samples GROUP BY ALL),
c AS (SELECT grid_id, score, sum(p) OVER w / sum(p) OVER g AS tpr, sum(n) OVER w / sum(n) OVER g AS fpr FROM d
  WINDOW w AS (PARTITION BY grid_id ORDER BY score), g AS (PARTITION BY grid_id))
SELECT grid_id, round(score, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (
  SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY tpr - fpr DESC, score) AS k FROM c) WHERE k = 1""", "raw_field samples")
def youden_le(spark, sf):
    y = E.youden_le(E.score_curve(V.samples(spark, sf), ["grid_id"]), ["grid_id"])
    return y.select("grid_id", *[r6(c).alias(c) for c in ("threshold", "tpr", "fpr")])


@query("youden_quantile", """
, q AS (SELECT DISTINCT grid_id, unnest(quantile_cont(score, list_transform(range(400), lambda i: 0.001::DOUBLE + (0.999::DOUBLE - 0.001::DOUBLE) * i / 399))) AS t
  FROM samples GROUP BY grid_id),
r AS (SELECT grid_id, t, count(*) FILTER (positive AND score >= t) / count(*) FILTER (positive) AS tpr,
  count(*) FILTER (NOT positive AND score >= t) / count(*) FILTER (NOT positive) AS fpr
  FROM q JOIN samples USING (grid_id) GROUP BY ALL)
SELECT grid_id, round(t, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (
  SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY tpr - fpr DESC, t) AS k FROM r) WHERE k = 1""", "raw_field samples")
def youden_quantile(spark, sf):
    y = E.youden_quantile(E.score_curve(V.samples(spark, sf), ["grid_id"]), ["grid_id"])
    return y.select("grid_id", *[r6(c).alias(c) for c in ("threshold", "tpr", "fpr")])


@query("tpr_at_fpr5", """
, t AS (SELECT grid_id, quantile_cont(score, 0.95) AS threshold FROM samples WHERE NOT positive GROUP BY grid_id)
SELECT grid_id, round(threshold, 6) AS threshold, round(count(*) FILTER (positive AND score >= threshold) / count(*) FILTER (positive), 6) AS tpr,
  round(count(*) FILTER (NOT positive AND score >= threshold) / count(*) FILTER (NOT positive), 6) AS fpr
FROM samples JOIN t USING (grid_id) GROUP BY grid_id, threshold""", "raw_field samples")
def tpr_at_fpr5(spark, sf):
    t = E.tpr_at_fpr(V.samples(spark, sf), ["grid_id"])
    return t.select("grid_id", *[r6(c).alias(c) for c in ("threshold", "tpr", "fpr")])


@query("adaptive_point", """
, t AS (SELECT grid_id, avg(score) + 0.1 AS threshold FROM samples WHERE NOT positive GROUP BY grid_id)
SELECT grid_id, round(threshold, 6) AS threshold, round(count(*) FILTER (positive AND score > threshold) / count(*) FILTER (positive), 6) AS tpr,
  round(count(*) FILTER (NOT positive AND score > threshold) / count(*) FILTER (NOT positive), 6) AS fpr
FROM samples JOIN t USING (grid_id) GROUP BY grid_id, threshold""", "raw_field samples")
def adaptive_point(spark, sf):
    t = E.adaptive_point(V.samples(spark, sf), ["grid_id"], 0.1)
    return t.select("grid_id", *[r6(c).alias(c) for c in ("threshold", "tpr", "fpr")])


@query("reference_evaluation", _AUC.format(k="grid_id", t="samples") + """
, t AS (SELECT grid_id, median(score) FILTER (positive) AS mp, median(score) FILTER (NOT positive) AS mn,
  quantile_cont(score, 0.95) FILTER (NOT positive) AS threshold FROM samples GROUP BY grid_id)
SELECT grid_id, n_pos AS n_ref, n_neg AS n_bg, round(auc, 6) AS auc, round(mp, 6) AS median_ref, round(mn, 6) AS median_bg,
  round(mp - mn, 6) AS excess, round(threshold, 6) AS threshold,
  round(count(*) FILTER (positive AND score > threshold) / n_pos, 6) AS tpr,
  round(count(*) FILTER (NOT positive AND score > threshold) / n_neg, 6) AS fpr
FROM samples JOIN t USING (grid_id) JOIN a USING (grid_id) GROUP BY grid_id, n_pos, n_neg, auc, mp, mn, threshold""", "raw_field samples")
def reference_evaluation(spark, sf):
    e = E.reference_evaluation(V.samples(spark, sf), ["grid_id"])
    return e.select("grid_id", "n_ref", "n_bg", *[
        r6(c).alias(c) for c in ("auc", "median_ref", "median_bg", "excess", "threshold", "tpr", "fpr")
    ])


@query("median_contrast", """
SELECT grid_id, count(*) FILTER (positive) AS n_ref, count(*) FILTER (NOT positive) AS n_bg,
  round(median(score) FILTER (positive), 6) AS median_ref, round(median(score) FILTER (NOT positive), 6) AS median_bg,
  round(median(score) FILTER (positive) - median(score) FILTER (NOT positive), 6) AS excess FROM samples GROUP BY grid_id""", "raw_field samples")
def median_contrast(spark, sf):
    m = E.class_medians(V.samples(spark, sf), ["grid_id"])
    return m.select("grid_id", "n_ref", "n_bg", *[r6(c).alias(c) for c in ("median_ref", "median_bg", "excess")])


_SENS = """
, l AS (SELECT grid_id, score, positive, 'v0' AS variant FROM samples
  UNION ALL SELECT grid_id, score, positive, 'v1' FROM samples WHERE positive OR label < 7
  UNION ALL SELECT grid_id, score, positive, 'v2' FROM samples WHERE positive OR label < 0)""" + _AUC.format(
    k="grid_id, variant", t="l"
) + """
, t AS (SELECT grid_id, variant, count(*) FILTER (positive) AS n_ref, count(*) FILTER (NOT positive) AS n_bg,
  median(score) FILTER (positive) - median(score) FILTER (NOT positive) AS excess,
  quantile_cont(score, 0.95) FILTER (NOT positive) AS lim FROM l GROUP BY ALL),
f AS (SELECT grid_id, variant, n_ref, n_bg, auc, excess, CASE WHEN lim IS NOT NULL THEN (SELECT avg(CASE WHEN score >= lim THEN 1.0 ELSE 0.0 END)
  FROM l WHERE positive AND l.grid_id = t.grid_id AND l.variant = t.variant) END AS tpr FROM t JOIN a USING (grid_id, variant))"""


def _sensitivity(spark, sf):
    label = F.col("label")
    return E.background_sensitivity(
        V.samples(spark, sf), ["grid_id"], {"v0": F.lit(True), "v1": label < 7, "v2": label < 0}
    )


@query("background_sensitivity", _SENS + """
SELECT grid_id, variant, n_ref, n_bg, round(auc, 6) AS auc, round(excess, 6) AS excess, round(tpr, 6) AS tpr_at_fpr5 FROM f""", "raw_field samples")
def background_sensitivity(spark, sf):
    return _sensitivity(spark, sf).select(
        "grid_id", "variant", "n_ref", "n_bg", *[r6(c).alias(c) for c in ("auc", "excess", "tpr_at_fpr5")]
    )


@query("mean_auc", _SENS + """
SELECT variant, round(avg(auc), 6) AS mean_auc, count(auc) AS n_events FROM f GROUP BY variant""", "raw_field samples")
def mean_auc(spark, sf):
    return E.mean_auc(_sensitivity(spark, sf), ["variant"]).withColumn("mean_auc", r6("mean_auc"))


@query("index_study", f"""
, w(name, a, b) AS (VALUES {_WEIGHTS}),
s AS (SELECT grid_id, name AS "index", CAST(a AS DOUBLE) * d_VV + CAST(b AS DOUBLE) * d_VH AS score, (col // 5 + "row" // 4) % 3 = 0 AS positive
  FROM deltas, w WHERE d_VV IS NOT NULL AND d_VH IS NOT NULL),
t AS (SELECT grid_id, "index", median(score) FILTER (positive) AS mr, median(score) FILTER (NOT positive) AS mb,
  avg(score) FILTER (NOT positive) + 2.9 AS lim FROM s GROUP BY ALL)""" + _AUC.format(k='grid_id, "index"', t="s") + """
SELECT grid_id, "index", n_pos AS n_ref, n_neg AS n_bg, round(mr - mb, 6) AS excess, round(auc, 6) AS auc,
  round(count(*) FILTER (positive AND score > lim) / n_pos, 6) AS adaptive_tpr,
  round(count(*) FILTER (NOT positive AND score > lim) / n_neg, 6) AS adaptive_fpr
FROM s JOIN t USING (grid_id, "index") JOIN a USING (grid_id, "index") WHERE n_pos >= 100 AND n_neg >= 100 GROUP BY grid_id, "index", n_pos, n_neg, mr, mb, auc, lim""", "stack db deltas")
def index_study(spark, sf):
    fam = stack.index_family(_deltas(spark, sf))
    pos = (F.floor(F.col("col") / 5) + F.floor(F.col("row") / 4)) % 3 == 0
    s = fam.select("grid_id", "index", F.col("value").alias("score"), pos.alias("positive"))
    e = E.index_study(s, ["grid_id", "index"])
    return e.select("grid_id", "index", "n_ref", "n_bg", *[r6(c).alias(c) for c in ("excess", "auc", "adaptive_tpr", "adaptive_fpr")])


@query("stride_sample", """
SELECT grid_id, count(*) AS n, round(sum(value), 6) AS total FROM raw_field WHERE "row" % 3 = 0 AND col % 3 = 0 GROUP BY grid_id""", "raw_field")
def stride_sample(spark, sf):
    s = stack.stride_sample(V.raw_field(spark, sf), 3)
    return s.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("spearman", """
SELECT o_orderpriority, n, round(corr(rx, ry), 6) AS rho FROM (
  SELECT o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS n,
    rank() OVER (PARTITION BY o_orderpriority ORDER BY x) + (count(*) OVER (PARTITION BY o_orderpriority, x) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY o_orderpriority ORDER BY y) + (count(*) OVER (PARTITION BY o_orderpriority, y) - 1) / 2 AS ry
  FROM (SELECT o_orderpriority, round(o_totalprice, -2) AS x, o_custkey AS y FROM orders)) GROUP BY ALL""")
def spearman(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderpriority", F.round("o_totalprice", -2).alias("x"), F.col("o_custkey").alias("y"))
    return order.spearman(o, ["o_orderpriority"], "x", "y").withColumn("rho", r6("rho"))


# -- masks ---------------------------------------------------------------------------------------

def _above(spark, sf, limit):
    return masks.from_predicate(V.raw_field(spark, sf), F.col("value") > limit)


def _below(spark, sf, limit):
    return masks.from_predicate(V.raw_field(spark, sf), F.col("value") < limit)


@query("mask_semi", """
SELECT grid_id, "row", col, round(control, 6) AS value FROM layers JOIN raw_field USING (grid_id, "row", col) WHERE value > 0.1""".replace("JOIN raw_field", "JOIN (SELECT grid_id, \"row\", col, value FROM raw_field)"), "raw_field layers")
def mask_semi(spark, sf):
    cells = V.layers(spark, sf).select(*CELL, r6("control").alias("value"))
    return masks.keep_inside(cells, _above(spark, sf, 0.1))


@query("mask_and", 'SELECT grid_id, "row", col FROM raw_field WHERE value > -0.05 AND value < 0.12', "raw_field")
def mask_and(spark, sf):
    return masks.intersect(_above(spark, sf, -0.05), _below(spark, sf, 0.12))


@query("mask_minus", 'SELECT grid_id, "row", col FROM raw_field WHERE value > 0.05 AND NOT (value > 0.2) AND NOT (value < 0.08)', "raw_field")
def mask_minus(spark, sf):
    return masks.subtract(_above(spark, sf, 0.05), _above(spark, sf, 0.2), _below(spark, sf, 0.08))


# -- neighbourhoods --------------------------------------------------------------------------------

def _window_sql(view, r, clamp="least(greatest({x}, 0), {m})"):
    rr = clamp.format(x='f."row" + dr', m="h - 1")
    cc = clamp.format(x="f.col + dc", m="w - 1")
    return f"""
, size AS (SELECT grid_id, max("row") + 1 AS h, max(col) + 1 AS w FROM {view} GROUP BY grid_id),
o AS (SELECT a - {r} AS dr, b - {r} AS dc FROM range({2 * r + 1}) t(a), range({2 * r + 1}) u(b)),
win AS (SELECT f.grid_id, f."row", f.col, f.value AS centre, g.value AS v
  FROM (SELECT f.*, {rr} AS rr, {cc} AS cc FROM {view} f JOIN size USING (grid_id), o) f
  JOIN {view} g ON g.grid_id = f.grid_id AND g."row" = f.rr AND g.col = f.cc)"""


@query("median_filter", _window_sql("field", 1) + """
SELECT grid_id, "row", col, CASE WHEN any_value(centre) IS NOT NULL THEN round(median(v), 6) END AS value FROM win
GROUP BY grid_id, "row", col""", "raw_field field")
def median_filter(spark, sf):
    return focal.median_filter(V.field(spark, sf), 3, tile=64).withColumn("value", r6("value"))


@query("median_filter_negative_rows", _window_sql("field", 1) + """
SELECT grid_id, "row" - 70 AS "row", col - 9 AS col, CASE WHEN any_value(centre) IS NOT NULL THEN round(median(v), 6) END AS value FROM win
GROUP BY grid_id, "row", col""", "raw_field field")
def median_filter_negative_rows(spark, sf):
    low = V.field(spark, sf).withColumn("row", F.col("row") - 70).withColumn("col", F.col("col") - 9)
    return focal.median_filter(low, 3, tile=64).withColumn("value", r6("value"))


@query("median_filter_sparse", _window_sql("sparse_field", 2) + """
SELECT grid_id, "row", col, CASE WHEN any_value(centre) IS NOT NULL THEN round(median(v), 6) END AS value FROM win
GROUP BY grid_id, "row", col""", "raw_field sparse_field")
def median_filter_sparse(spark, sf):
    return focal.median_filter(V.sparse_field(spark, sf), 5).withColumn("value", r6("value"))


@query("box_mean", _window_sql("field", 2) + """
SELECT grid_id, "row", col, CASE WHEN count(v) / 25.0 >= 0.30 THEN round(sum(v) / count(v), 6) END AS value FROM win
GROUP BY grid_id, "row", col""", "raw_field field")
def box_mean(spark, sf):
    return focal.box_mean(V.field(spark, sf), 5, tile=64).withColumn("value", r6("value"))


@query("box_mean_sparse", _window_sql("sparse_field", 1) + """
SELECT grid_id, "row", col, CASE WHEN count(v) / 9.0 >= 0.30 THEN round(sum(v) / count(v), 6) END AS value FROM win
GROUP BY grid_id, "row", col""", "raw_field sparse_field")
def box_mean_sparse(spark, sf):
    return focal.box_mean(V.sparse_field(spark, sf), 3).withColumn("value", r6("value"))


@query("majority_filter", """
, b AS (SELECT grid_id, "row", col, CASE WHEN value > 0 THEN 1 ELSE 0 END AS value FROM raw_field)""" + _window_sql("b", 1) + """
SELECT grid_id, "row", col, CASE WHEN sum(v) * 2 > 9 THEN 1 ELSE 0 END AS value FROM win GROUP BY grid_id, "row", col""", "raw_field")
def majority_filter(spark, sf):
    m = V.raw_field(spark, sf).select(*CELL, (F.col("value") > 0).cast("int").alias("value"))
    return focal.majority_filter(m, 3)


@query("lee_filter", _window_sql("field", 2, "CASE WHEN {x} < 0 THEN -({x}) - 1 WHEN {x} > {m} THEN 2 * ({m}) + 1 - ({x}) ELSE {x} END") + """
, g AS (SELECT grid_id, var_pop(value) AS av FROM field GROUP BY grid_id),
s AS (SELECT grid_id, "row", col, any_value(centre) AS c, coalesce(sum(v), 0) / greatest(count(v), 1) AS m,
  coalesce(sum(v * v), 0) / greatest(count(v), 1) AS q FROM win GROUP BY grid_id, "row", col),
k AS (SELECT *, greatest(q - m * m, 0) / (greatest(q - m * m, 0) + av + 1e-10) AS w FROM s JOIN g USING (grid_id))
SELECT grid_id, "row", col, round(CASE WHEN c IS NOT NULL THEN w * m + (1 - w) * c ELSE m END, 6) AS value FROM k""", "raw_field field")
def lee_filter(spark, sf):
    return focal.lee_filter(V.field(spark, sf), 5).select(*CELL, r6("value").alias("value"))


@query("binary_closing", """
, b AS (SELECT grid_id, "row", col, value > 0.2 AS m FROM raw_field),
size AS (SELECT grid_id, max("row") + 1 AS h, max(col) + 1 AS w FROM b GROUP BY grid_id),
o AS (SELECT a - 1 AS dr, c - 1 AS dc FROM range(3) t(a), range(3) u(c)),
dil AS (SELECT DISTINCT grid_id, "row" + dr AS "row", col + dc AS col FROM b JOIN size USING (grid_id), o
  WHERE m AND "row" + dr BETWEEN 0 AND h - 1 AND col + dc BETWEEN 0 AND w - 1)
SELECT f.grid_id, f."row", f.col, CASE WHEN count(d.col) = 9 THEN 1 ELSE 0 END AS value
FROM b f CROSS JOIN o LEFT JOIN dil d ON d.grid_id = f.grid_id AND d."row" = f."row" + dr AND d.col = f.col + dc
GROUP BY f.grid_id, f."row", f.col""", "raw_field")
def binary_closing(spark, sf):
    m = V.raw_field(spark, sf).select(*CELL, (F.col("value") > 0.2).cast("int").alias("value"))
    return focal.binary_closing(m, 3, tile=64)


@query("slope", """
, n AS (SELECT grid_id, "row", col, value, lag(value) OVER r AS l, lead(value) OVER r AS n, lag(value) OVER c AS u, lead(value) OVER c AS d
  FROM raw_field WINDOW r AS (PARTITION BY grid_id, "row" ORDER BY col), c AS (PARTITION BY grid_id, col ORDER BY "row")),
g AS (SELECT *, CASE WHEN l IS NULL THEN n - value WHEN n IS NULL THEN value - l ELSE (n - l) / 2 END / 30 AS gx,
  CASE WHEN u IS NULL THEN d - value WHEN d IS NULL THEN value - u ELSE (d - u) / 2 END / 20 AS gy FROM n)
SELECT grid_id, "row", col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM g""", "raw_field")
def slope(spark, sf):
    s = focal.slope(V.raw_field(spark, sf).select(*CELL, "value"), 30.0, 20.0)
    return s.select(*CELL, r6("slope").alias("slope"))


@query("slope_stats", """
, n AS (SELECT grid_id, "row", col, label, value, lag(value) OVER r AS l, lead(value) OVER r AS n, lag(value) OVER c AS u, lead(value) OVER c AS d
  FROM raw_field WINDOW r AS (PARTITION BY grid_id, "row" ORDER BY col), c AS (PARTITION BY grid_id, col ORDER BY "row")),
g AS (SELECT *, CASE WHEN l IS NULL THEN n - value WHEN n IS NULL THEN value - l ELSE (n - l) / 2 END / 3 AS gx,
  CASE WHEN u IS NULL THEN d - value WHEN d IS NULL THEN value - u ELSE (d - u) / 2 END / 2 AS gy FROM n),
s AS (SELECT grid_id, label, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM g)
SELECT grid_id, label, round(avg(slope), 2) AS slope_mean_deg, round(quantile_cont(slope, 0.9), 2) AS slope_p90_deg FROM s GROUP BY ALL""", "raw_field")
def slope_stats(spark, sf):
    s = settle(focal.slope(V.raw_field(spark, sf), 3.0, 2.0))
    p = order.quantiles(s, ["grid_id", "label"], "slope", {"p90": 0.9})
    return p.join(s.groupBy("grid_id", "label").agg(F.avg("slope").alias("m")), ["grid_id", "label"]).select(
        "grid_id", "label", r6("m", 2).alias("slope_mean_deg"), r6("p90", 2).alias("slope_p90_deg")
    )


@query("distance_ring", """
, ref AS (SELECT grid_id, "row", col FROM field WHERE value > 0.2),
near AS (SELECT DISTINCT f.grid_id, f."row", f.col FROM field f JOIN ref r ON f.grid_id = r.grid_id AND f."row" BETWEEN r."row" - 4 AND r."row" + 4
  AND f.col BETWEEN r.col - 4 AND r.col + 4 AND (f."row" - r."row") * (f."row" - r."row") + (f.col - r.col) * (f.col - r.col) <= 16)
SELECT grid_id, "row", col FROM near ANTI JOIN ref USING (grid_id, "row", col)""", "raw_field field")
def distance_ring(spark, sf):
    cells = V.field(spark, sf)
    shape = cells.groupBy("grid_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return focal.distance_ring(cells.where("value > 0.2"), 4, shape)


@query("distance_ring_far", """
, ref AS (SELECT grid_id, "row", col FROM raw_field WHERE value > 0.42),
d AS (SELECT f.grid_id, f."row", f.col, min((f."row" - r."row") * (f."row" - r."row") + (f.col - r.col) * (f.col - r.col)) AS d2
  FROM raw_field f JOIN ref r ON f.grid_id = r.grid_id GROUP BY ALL)
SELECT grid_id, "row", col FROM d WHERE d2 > 30 * 30 AND d2 <= 1000 * 1000""", "raw_field")
def distance_ring_far(spark, sf):
    """From 30 to 1000 cells around few cells: wider than the grids, so every cell is measured."""
    cells = V.raw_field(spark, sf)
    shape = cells.groupBy("grid_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return focal.distance_ring(cells.where("value > 0.42"), 1000, shape, 30)


@query("threshold_map", _window_sql("field", 1) + """
, b AS (SELECT grid_id, "row", col, CASE WHEN count(v) / 9.0 >= 0.30 THEN sum(v) / count(v) END AS value FROM win GROUP BY grid_id, "row", col)"""
       + _window_sql("b", 1).replace("size AS", "size2 AS").replace("JOIN size", "JOIN size2").replace("o AS", "o2 AS").replace(", o)", ", o2)").replace("win AS", "win2 AS") + """
, m AS (SELECT grid_id, "row", col, CASE WHEN any_value(centre) IS NOT NULL THEN median(v) END AS value FROM win2 GROUP BY grid_id, "row", col),
t AS (SELECT grid_id, avg(value) + 0.03 AS threshold FROM field GROUP BY grid_id)
SELECT grid_id, "row", col, round(m.value, 6) AS value FROM m JOIN t USING (grid_id) WHERE m.value > threshold AND col >= 10""", "raw_field field")
def threshold_map(spark, sf):
    cells = V.field(spark, sf)
    t = stack.mean_threshold(cells, 0.03)
    inside = cells.where("col >= 10").select(*CELL)
    return focal.threshold_map(cells, t, 3, 3, inside, tile=64).withColumn("value", r6("value"))


@query("preprocess", """
, p AS (SELECT grid_id, "row", col, 10 * log10(value + 1) AS value FROM raw_field)""" + _window_sql("p", 1, "CASE WHEN {x} < 0 THEN -({x}) - 1 WHEN {x} > {m} THEN 2 * ({m}) + 1 - ({x}) ELSE {x} END") + """
, g AS (SELECT grid_id, var_pop(value) AS av FROM p GROUP BY grid_id),
s AS (SELECT grid_id, "row", col, any_value(centre) AS c, sum(v) / count(v) AS m, sum(v * v) / count(v) AS q FROM win GROUP BY grid_id, "row", col),
k AS (SELECT *, greatest(q - m * m, 0) / (greatest(q - m * m, 0) + av + 1e-10) AS w FROM s JOIN g USING (grid_id)),
f AS (SELECT grid_id, "row", col, w * m + (1 - w) * c AS x FROM k)
SELECT grid_id, "row", col, round(CASE WHEN x >= -0.5 THEN x END, 5) AS value FROM f""", "raw_field")
def preprocess(spark, sf):
    cells = V.raw_field(spark, sf).select(
        "grid_id", F.lit("s").alias("scene_id"), F.lit("VV").alias("band"), "row", "col", (F.col("value") + 1).alias("value")
    )
    return focal.preprocess(cells, 3, water_db=-0.5).select(*CELL, r6("value", 5).alias("value"))


# -- order statistics of long keys -------------------------------------------------------------------

@query("quantiles_narrowed", """
SELECT l_returnflag, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS med, round(quantile_cont(v, 0.9), 6) AS p90
FROM (SELECT l_returnflag, 1000000 + l_extendedprice / 1000 AS v FROM lineitem) GROUP BY l_returnflag""")
def quantiles_narrowed(spark, sf):
    """Values far from zero and close together, and brackets of at most 200: every one is cut several times."""
    v = F.lit(1000000) + F.col("l_extendedprice").cast("double") / 1000
    rows = V.table(spark, sf, "lineitem").select("l_returnflag", v.alias("v"))
    q = order.quantiles(rows, ["l_returnflag"], "v", {"p25": 0.25, "med": 0.5, "p90": 0.9}, task_rows=200, fan=64)
    return q.select("l_returnflag", "n", *[r6(c).alias(c) for c in ("p25", "med", "p90")])


@query("auc_ranges", """
WITH s AS (SELECT event_type AS grid_id, CASE WHEN event_id = 1 THEN 1e15 ELSE value END AS score, user_id % 2 = 0 AS positive FROM events)"""
       + _AUC.format(k="grid_id", t="s") + """
SELECT grid_id, n_pos, n_neg, round(auc, 6) AS auc FROM a""")
def auc_ranges(spark, sf):
    """Every key spans several value ranges, one has an outlier."""
    score = F.when(F.col("event_id") == 1, F.lit(1e15)).otherwise(F.col("value"))
    s = V.table(spark, sf, "events").select(
        F.col("event_type").alias("grid_id"), score.alias("score"), (F.col("user_id") % 2 == 0).alias("positive")
    )
    return E.rank_auc(E.score_curve(s, ["grid_id"], 500), ["grid_id"]).withColumn("auc", r6("auc"))


@query("spearman_ranges", """
SELECT o_orderpriority, n, round(corr(rx, ry), 6) AS rho FROM (
  SELECT o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS n,
    rank() OVER (PARTITION BY o_orderpriority ORDER BY x) + (count(*) OVER (PARTITION BY o_orderpriority, x) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY o_orderpriority ORDER BY y) + (count(*) OVER (PARTITION BY o_orderpriority, y) - 1) / 2 AS ry
  FROM (SELECT o_orderpriority, CASE WHEN o_orderkey = 1 THEN 1e15 ELSE round(o_totalprice, -2) END AS x, o_custkey AS y FROM orders)) GROUP BY ALL""")
def spearman_ranges(spark, sf):
    """As ``spearman``, with an outlier and keys that span several ranges of each column."""
    x = F.when(F.col("o_orderkey") == 1, F.lit(1e15)).otherwise(F.round("o_totalprice", -2))
    o = V.table(spark, sf, "orders").select("o_orderpriority", x.alias("x"), F.col("o_custkey").alias("y"))
    return order.spearman(o, ["o_orderpriority"], "x", "y", 300).withColumn("rho", r6("rho"))
