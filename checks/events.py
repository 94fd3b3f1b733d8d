"""Catalogues, names, dates, chains, screening and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query, r6
from deltacell.functions import dates as D
from deltacell.functions import naming as N
from deltacell.operators import chains as C
from deltacell.operators import order
from deltacell.operators import screening as X
from deltacell.plans import sites as P
from deltacell.session import settle
from deltacell.sources import catalogs, tables

# -- names -----------------------------------------------------------------------------------------

_PATHS_SQL = """
, n AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d') AS d1, strftime(o_orderdate + to_days(CAST(6 * (o_orderkey % 5) AS INTEGER)), '%Y%m%d') AS d2,
  printf('%04X', o_custkey % 65536) AS pid, CAST(o_orderkey % 4 AS INTEGER) AS kind, ['VV', 'VH'][o_custkey % 2 + 1] AS pol, ['40', '80'][o_custkey % 3 // 2 + 1] AS sp FROM orders),
names AS (SELECT *, CASE kind
  WHEN 0 THEN 'S1AB_' || d1 || 'T030234_' || d2 || 'T030301_' || pol || 'P0' || lpad(CAST(6 * (id % 5) AS VARCHAR), 2, '0') || '_INT' || sp || '_G_ueF_' || pid
  WHEN 1 THEN 'S1_' || lpad(CAST(id % 175 AS VARCHAR), 3, '0') || '_' || lpad(CAST(id % 999999 AS VARCHAR), 6, '0') || 's1n02-000000s2n00_IW_' || d1 || '_' || d2 || '_' || pol || '_INT' || sp || '_' || pid
  WHEN 2 THEN 'S1C_' || d1 || 'T030234_' || d2 || 'T030301_' || pol || 'R012_INT' || sp || '_G_unF_' || lower(pid)
  ELSE 'custom_' || CAST(id AS VARCHAR) END AS name FROM n),
paths AS (SELECT *, CASE id % 3 WHEN 0 THEN '/data/' || name || '.zip' WHEN 1 THEN '/data/' || name || '/' || name || '_corr.tif'
  ELSE '/data/' || name || '/layer_wm.tif' END AS path FROM names)""".replace(", n AS", "WITH n AS", 1)


def _paths(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    d1, d2 = F.date_format(day, "yyyyMMdd"), F.date_format(F.date_add(day, (k % 5 * 6).cast("int")), "yyyyMMdd")
    pid = F.lpad(F.hex(c % 65536), 4, "0")
    pol = F.when(c % 2 == 0, "VV").otherwise("VH")
    sp = F.when(c % 3 == 2, "80").otherwise("40")
    times = [d1, F.lit("T030234_"), d2, F.lit("T030301_"), pol]
    six = F.lpad((k % 5 * 6).cast("string"), 2, "0")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("S1AB_"), *times, F.lit("P0"), six, F.lit("_INT"), sp, F.lit("_G_ueF_"), pid))
        .when(k % 4 == 1, F.concat(
            F.lit("S1_"), F.lpad((k % 175).cast("string"), 3, "0"), F.lit("_"), F.lpad((k % 999999).cast("string"), 6, "0"),
            F.lit("s1n02-000000s2n00_IW_"), d1, F.lit("_"), d2, F.lit("_"), pol, F.lit("_INT"), sp, F.lit("_"), pid,
        ))
        .when(k % 4 == 2, F.concat(F.lit("S1C_"), *times, F.lit("R012_INT"), sp, F.lit("_G_unF_"), F.lower(pid)))
        .otherwise(F.concat(F.lit("custom_"), k.cast("string")))
    )
    rows = V.table(spark, sf, "orders").select(k.alias("id"), name.alias("name"))
    n = F.col("name")
    path = (
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("/data/"), n, F.lit(".zip")))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("/data/"), n, F.lit("/"), n, F.lit("_corr.tif")))
        .otherwise(F.concat(F.lit("/data/"), n, F.lit("/layer_wm.tif")))
    )
    return rows.withColumn("path", path)


_PARSED = _PATHS_SQL + """
, parsed AS (SELECT id, kind, CASE WHEN kind = 3 THEN CASE id % 3 WHEN 2 THEN 'layer' ELSE name END ELSE name END AS granule,
  CASE kind WHEN 0 THEN 'gamma' WHEN 1 THEN 'isce' WHEN 2 THEN 'gamma' END AS family, CASE kind WHEN 0 THEN 'A' WHEN 2 THEN 'C' END AS platform,
  CASE WHEN kind = 1 THEN CAST(id % 175 AS INTEGER) END AS track, CASE WHEN kind < 3 THEN pol END AS pol, CASE WHEN kind < 3 THEN CAST(sp AS INTEGER) END AS spacing_m,
  CASE WHEN kind < 3 THEN pid END AS pid, CASE kind WHEN 1 THEN d1 WHEN 3 THEN NULL ELSE d1 || 'T030234' END AS date1,
  CASE kind WHEN 1 THEN d2 WHEN 3 THEN NULL ELSE d2 || 'T030301' END AS date2,
  CASE WHEN kind = 1 THEN lpad(CAST(id % 999999 AS VARCHAR), 6, '0') || 's1n02-000000s2n00' END AS burst_key,
  CASE kind WHEN 0 THEN 'P0' || lpad(CAST(6 * (id % 5) AS VARCHAR), 2, '0') WHEN 2 THEN 'R012' END AS orbit_code FROM paths)"""

_PRODUCT_COLS = ("family", "platform", "track", "pol", "spacing_m", "pid", "date1", "date2", "burst_key", "orbit_code")


@query("parse_products", _PARSED + """
SELECT id, granule, family, platform, track, pol, spacing_m, pid, date1, date2, burst_key, orbit_code FROM parsed WHERE kind < 3
UNION ALL SELECT id, CASE id % 3 WHEN 0 THEN granule WHEN 1 THEN granule ELSE 'layer' END, family, platform, track, pol, spacing_m, pid, date1, date2, burst_key, orbit_code
FROM parsed WHERE kind = 3""")
def parse_products(spark, sf):
    return _paths(spark, sf).select("id", N.parse_product(F.col("path")).alias("p")).select("id", "p.granule", *[f"p.{c}" for c in _PRODUCT_COLS])


def _pairs(spark, sf):
    parsed = settle(_paths(spark, sf).select("id", N.parse_product(F.col("path")).alias("p")))
    later = parsed.select((F.col("id") - 4).alias("id"), F.col("p").alias("q"))
    return parsed.join(later, "id")


@query("pair_issues", _PARSED + """
SELECT a.id, concat_ws(',', CASE WHEN a.family IS DISTINCT FROM b.family THEN 'error:family' END,
  CASE WHEN a.family = 'isce' AND a.burst_key <> b.burst_key THEN 'error:burst' END, CASE WHEN a.family = 'isce' AND a.track <> b.track THEN 'error:track' END,
  CASE WHEN a.pol <> b.pol THEN 'error:pol' END, CASE WHEN a.family = 'gamma' AND a.orbit_code <> b.orbit_code THEN 'warning:orbit_code' END,
  CASE WHEN a.spacing_m <> b.spacing_m THEN 'warning:spacing' END) AS issues
FROM parsed a JOIN parsed b ON b.id = a.id + 4""")
def pair_issues(spark, sf):
    return _pairs(spark, sf).select("id", F.array_join(C.pair_issues(F.col("p"), F.col("q")), ",").alias("issues"))


@query("temporal_issues", _PARSED + """
, d AS (SELECT id, strptime(substr(date1, 1, 8), '%Y%m%d')::DATE AS a, strptime(substr(date2, 1, 8), '%Y%m%d')::DATE AS b FROM parsed)
SELECT x.id, CASE WHEN x.a IS NULL OR y.a IS NULL THEN 'warning:dates_unknown' WHEN x.b <= x.a OR y.b <= y.a THEN 'error:not_increasing'
  ELSE concat_ws(',', CASE WHEN abs((x.b - x.a) - (y.b - y.a)) > 1 THEN 'warning:baseline' END, 'warning:confirm_straddle') END AS drop_issues,
  CASE WHEN x.a IS NULL OR y.a IS NULL THEN 'warning:dates_unknown' WHEN x.b <= x.a OR y.b <= y.a THEN 'error:not_increasing'
  ELSE concat_ws(',', CASE WHEN abs((x.b - x.a) - (y.b - y.a)) > 1 THEN 'warning:baseline' END, CASE WHEN y.b >= x.a THEN 'error:baseline_not_before' END) END AS gain_issues
FROM d x JOIN d y ON y.id = x.id + 4""")
def temporal_issues(spark, sf):
    p, q = F.col("p"), F.col("q")
    return _pairs(spark, sf).select(
        "id", F.array_join(C.temporal_issues(p, q), ",").alias("drop_issues"),
        F.array_join(C.temporal_issues(p, q, "persistent_gain"), ",").alias("gain_issues"),
    )


@query("polarization_token", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CASE l_returnflag WHEN 'A' THEN 'VV' WHEN 'N' THEN 'VH' ELSE 'HH' END ELSE '' END AS band,
  l_linenumber % 2 = 0 AND l_linenumber % 3 <> 0 AS measurement FROM lineitem""")
def polarization_token(spark, sf):
    n = F.col("l_linenumber")
    pol = F.when(F.col("l_returnflag") == "A", "vv").when(F.col("l_returnflag") == "N", "VH").otherwise("hh")
    ext = F.when(n % 3 == 0, "-calibration.tif").otherwise("-001.tiff")
    path = F.concat(F.lit("/in/s1a-iw-grd"), F.when(n % 2 == 0, "-").otherwise("x"), pol, ext)
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", path.alias("path"))
    return rows.select("l_orderkey", "l_linenumber", N.polarization(F.col("path")).alias("band"), N.is_measurement(F.col("path")).alias("measurement"))


@query("slc_names", """
SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'S1A' ELSE 'S1B' END AS platform, date_trunc('second', ts) AS start, CAST(user_id * 7 % 175 AS INTEGER) AS orbit_key,
  strftime(ts, '%Y%m%d') AS date, CAST(user_id * 7 AS INTEGER) AS abs_orbit FROM events""")
def slc_names(spark, sf):
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    sat = F.when(F.col("event_id") % 2 == 0, "S1A").otherwise("S1B")
    title = F.concat(sat, F.lit("_IW_SLC__1SDV_"), stamp, F.lit("_"), stamp, F.lit("_"), F.lpad((F.col("user_id") * 7).cast("string"), 6, "0"), F.lit("_01ABCD_6660"))
    rows = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), title.alias("t"))
    s, strict = N.split_slc(F.col("t")), N.parse_slc(F.col("t"))
    return rows.select("id", s["platform"].alias("platform"), s["start"].alias("start"), s["orbit_key"].alias("orbit_key"), strict["date"].alias("date"), strict["abs_orbit"].alias("abs_orbit"))


_CSLC_SQL = """
, c AS (SELECT event_id AS id, CAST(user_id % 175 + 1 AS INTEGER) AS track, CAST(event_id % 9999 AS INTEGER) AS frame, CAST(event_id % 3 + 1 AS INTEGER) AS iw,
  CASE WHEN event_id % 2 = 0 THEN 'VV' ELSE 'VH' END AS pol, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H%M%S') AS time, CASE WHEN event_id % 5 <> 0 THEN 'S1A' END AS sat FROM events)""".replace(", c AS", "WITH c AS", 1)


def _cslc(spark, sf):
    e = F.col("event_id")
    day, tod = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmmss")
    head = F.concat(F.lit("OPERA_L2_CSLC-S1_T"), (F.col("user_id") % 175 + 1).cast("string"), F.lit("-"), (e % 9999).cast("string"), F.lit("-IW"), (e % 3 + 1).cast("string"), F.lit("_"))
    pol = F.when(e % 2 == 0, "VV").otherwise("VH")
    stamp = F.concat(day, F.lit("T"), tod, F.lit("Z"))
    name = F.when(e % 5 == 0, F.concat(head, pol, F.lit("_"), stamp)).otherwise(F.concat(head, stamp, F.lit("_20240301T000000Z_S1A_"), pol, F.lit("_v1.1")))
    return V.table(spark, sf, "events").select(e.alias("id"), N.parse_cslc(name).alias("p")).select("id", "p.*")


@query("cslc_names", _CSLC_SQL + "SELECT id, track, frame, iw, pol, date, time, sat FROM c")
def cslc_names(spark, sf):
    return _cslc(spark, sf)


@query("pass_frames", _CSLC_SQL + """
SELECT track, CAST(frame % 10 AS INTEGER) AS frame, count(*) AS n, string_agg(DISTINCT pol, ',' ORDER BY pol) AS pols, string_agg(DISTINCT coalesce(sat, '?'), ',' ORDER BY coalesce(sat, '?')) AS sats,
  count(DISTINCT time) AS n_times FROM c GROUP BY track, frame % 10""")
def pass_frames(spark, sf):
    f = C.pass_frames(_cslc(spark, sf).withColumn("frame", (F.col("frame") % 10).cast("int")))
    return f.select("track", "frame", "n", F.array_join("pols", ",").alias("pols"), F.array_join("sats", ",").alias("sats"), F.size("times").cast("bigint").alias("n_times"))


@query("time_closeness", """
WITH t AS (SELECT event_id AS id, hour(ts) * 60 + minute(ts) AS m FROM events)
SELECT id, least(abs(m - 5), 1440 - abs(m - 5)) <= 10 AS close, CAST(round_even((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 90, 0) AS INTEGER) AS bucket
FROM t JOIN events ON event_id = id""")
def time_closeness(spark, sf):
    ts = F.col("ts")
    return V.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), D.time_close(ts, 5).alias("close"), F.substring(D.time_bucket(ts), 4, 9).cast("int").alias("bucket")
    )


@query("job_links", """
WITH j AS (SELECT o_custkey AS event_id, CASE o_orderkey % 3 WHEN 0 THEN 'prepost' WHEN 1 THEN 'control' ELSE 'other' END AS kind, o_orderkey FROM orders)
SELECT CAST(event_id AS VARCHAR) AS event_id, max(o_orderkey) FILTER (kind = 'control') AS control, max(o_orderkey) FILTER (kind = 'prepost') AS prepost FROM j GROUP BY event_id""")
def job_links(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("id"), F.col("o_custkey").cast("string"), F.when(k % 3 == 0, "-coh-prepost").when(k % 3 == 1, "-coh-control").otherwise("-run"))
    jobs = V.table(spark, sf, "orders").select(k.alias("job"), N.job_link(name).alias("l")).select("job", "l.*")
    return jobs.groupBy("event_id").pivot("kind", ["control", "prepost"]).agg(F.max("job"))


@query("parse_dates", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 4 = 1 THEN month(o_orderdate) END AS month,
  year(o_orderdate) AS first_year, CASE o_custkey % 3 WHEN 0 THEN d || ' (exact)' WHEN 1 THEN d || '..x' ELSE '-' END AS label
FROM (SELECT *, strftime(o_orderdate, '%Y/%m/%d') AS d FROM orders)""")
def parse_dates(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(
        k % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")
    ).otherwise(F.concat(F.lit("about "), F.year("o_orderdate").cast("string")))
    d = F.date_format("o_orderdate", "yyyy/MM/dd")
    second = F.when(F.col("o_custkey") % 3 == 0, d).when(F.col("o_custkey") % 3 == 1, "x").otherwise("")
    first = F.when(F.col("o_custkey") % 3 == 2, "").otherwise(d)
    t = V.table(spark, sf, "orders").select(k.alias("id"), text.alias("t"), first.alias("a"), second.alias("b"))
    return t.select(
        "id", D.parse_date(F.col("t")).alias("date"), D.month_of(F.when(F.col("id") % 4 == 1, F.col("t"))).alias("month"),
        D.first_year(F.col("t")).alias("first_year"), D.date_label(F.col("a"), F.col("b")).alias("label"),
    )


# -- chains ----------------------------------------------------------------------------------------

@query("slc_triples", """
, d AS (SELECT platform, orbit_key, CAST(ts AS DATE) AS d, max(title) AS g, CAST(hour(min(ts)) AS INTEGER) AS pass_hour FROM granules GROUP BY ALL),
t AS (SELECT *, lead(d) OVER w AS d2, lead(d, 2) OVER w AS d3, lead(g) OVER w AS g2, lead(g, 2) OVER w AS g3 FROM d WINDOW w AS (PARTITION BY platform, orbit_key ORDER BY d))
SELECT event_id, event_date, platform, orbit_key, d AS d1, d2, d3, g AS g1, g2, g3, pass_hour, CAST(greatest(event_date - d, d2 - event_date) AS INTEGER) AS gap_days
FROM t JOIN storms ON d < event_date AND event_date < d2 WHERE d2 - d = 12 AND d3 - d2 = 12""", "granules storms")
def slc_triples(spark, sf):
    return C.exact_triples(V.granules(spark, sf), V.storms(spark, sf))


@query("slc_chains", """
, r AS (SELECT *, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY event_id, platform, orbit_key, CAST(ts AS DATE) ORDER BY cov DESC, ts) AS k FROM granules),
t AS (SELECT event_id, platform, orbit_key, ts, cov, lead(ts) OVER w AS ts2, lead(ts, 2) OVER w AS ts3, lead(cov) OVER w AS cov2, lead(cov, 2) OVER w AS cov3
  FROM r WHERE k = 1 WINDOW w AS (PARTITION BY event_id, platform, orbit_key ORDER BY ts)),
s AS (SELECT *, CAST((epoch_us(ts2) - epoch_us(ts)) // 86400000000 AS INTEGER) AS i1, CAST((epoch_us(ts3) - epoch_us(ts2)) // 86400000000 AS INTEGER) AS i2,
  least(cov, cov2, cov3) AS c FROM t JOIN storms USING (event_id) WHERE ts3 IS NOT NULL AND ts < event_date AND event_date <= ts2),
q AS (SELECT *, CASE WHEN c >= 0.95 THEN CASE WHEN i1 <= 14 AND i2 <= 14 THEN 'full' ELSE 'stretched' END WHEN c >= 0.85 THEN 'partial' ELSE 'none' END AS quality
  FROM s WHERE i1 BETWEEN 10 AND 27 AND i2 BETWEEN 10 AND 27),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE quality WHEN 'full' THEN 3 WHEN 'stretched' THEN 2 ELSE 1 END DESC, c DESC, ts, platform DESC, orbit_key DESC) AS k
  FROM q WHERE quality <> 'none')
SELECT event_id, platform, orbit_key AS rel_orbit, CAST(ts AS DATE) AS pre, CAST(ts2 AS DATE) AS post, CAST(ts3 AS DATE) AS control, i1 AS pair_interval_days,
  i2 AS control_interval_days, round(c, 3) AS min_coverage, quality,
  CAST((epoch_us(CAST(event_date AS TIMESTAMP)) - epoch_us(ts)) // 86400000000 AS INTEGER) AS gap_days_pre,
  CAST((epoch_us(ts2) - epoch_us(CAST(event_date AS TIMESTAMP))) // 86400000000 AS INTEGER) AS gap_days_post FROM b WHERE k = 1""", "granules storms")
def slc_chains(spark, sf):
    c = C.select_chains(V.granules(spark, sf), V.storms(spark, sf))
    return c.select("event_id", "platform", "rel_orbit", "pre", "post", "control", "pair_interval_days", "control_interval_days", r6("min_coverage", 3).alias("min_coverage"), "quality", "gap_days_pre", "gap_days_post")


def _windows(spark, sf):
    d = F.col("event_date")
    return V.storms(spark, sf).select(
        "event_id", F.date_sub(d, 90).alias("pre_from"), F.date_sub(d, 1).alias("pre_to"), d.alias("post_from"), F.date_add(d, 60).alias("post_to"), F.lit(2).alias("min_pre")
    )


@query("scene_plan", """
, s AS (SELECT event_id, platform AS orbit_key, title, ts, CASE WHEN CAST(ts AS DATE) BETWEEN event_date - 90 AND event_date - 1 THEN 'pre'
  WHEN CAST(ts AS DATE) BETWEEN event_date AND event_date + 60 THEN 'post' END AS side FROM granules JOIN storms USING (event_id)),
z AS (SELECT event_id, orbit_key, count(*) FILTER (side = 'pre') AS n_pre, count(*) FILTER (side = 'post') AS n_post, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT event_id, orbit_key FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n_post >= 2 DESC, least(n_pre, 4) DESC, n_post DESC, n DESC, orbit_key DESC) AS k
  FROM z WHERE n_post >= 1 AND n_pre >= 2) WHERE k = 1),
u AS (SELECT s.*, row_number() OVER (PARTITION BY event_id, side ORDER BY ts DESC, title DESC) AS b, row_number() OVER (PARTITION BY event_id, side ORDER BY ts, title) AS a
  FROM s JOIN c USING (event_id, orbit_key) WHERE side IS NOT NULL)
SELECT event_id, orbit_key, CASE WHEN side = 'pre' THEN ['base', 'pre1', 'pre2', 'pre3'][b] WHEN a = 1 THEN 'post' ELSE 'post2' END AS label, title AS scene_id, ts
FROM u WHERE (side = 'pre' AND b <= 4) OR (side = 'post' AND a <= 2)""", "granules storms")
def scene_plan(spark, sf):
    scenes = V.granules(spark, sf).select("event_id", F.col("platform").alias("orbit_key"), F.col("title").alias("scene_id"), "ts")
    return C.scene_plan(scenes, _windows(spark, sf))


@query("insar_pairs", """
, d AS (SELECT DISTINCT event_id, platform, event_date, CAST(ts AS DATE) AS d FROM granules JOIN storms USING (event_id)),
b AS (SELECT event_id, platform, d, row_number() OVER (PARTITION BY event_id, platform ORDER BY d DESC) AS k FROM d WHERE d < event_date),
a AS (SELECT event_id, platform, d, row_number() OVER (PARTITION BY event_id, platform ORDER BY d) AS k FROM d WHERE d > event_date),
p AS (SELECT 'primary_straddling_event' AS kind, b.event_id, b.platform, b.d AS ref, a.d AS sec FROM b JOIN a USING (event_id, platform) WHERE b.k = 1 AND a.k = 1
  UNION ALL SELECT 'control_pre_pre', x.event_id, x.platform, y.d, x.d FROM b x JOIN b y USING (event_id, platform) WHERE x.k = 1 AND y.k = 2
  UNION ALL SELECT 'control_post_post', x.event_id, x.platform, x.d, y.d FROM a x JOIN a y USING (event_id, platform) WHERE x.k = 1 AND y.k = 2)
SELECT event_id, platform, event_date, kind, ref, sec, CAST(sec - ref AS INTEGER) AS baseline_days FROM p JOIN storms USING (event_id)""", "granules storms")
def insar_pairs(spark, sf):
    dates = V.granules(spark, sf).join(V.storms(spark, sf), "event_id").select("event_id", "platform", "event_date", F.to_date("ts").alias("d"))
    return C.interferometric_pairs(dates, ["event_id", "platform"])


@query("nearest_scene", """
, m AS (SELECT event_id, platform, event_date AS date, title AS scene_id, ts, row_number() OVER (PARTITION BY event_id, platform ORDER BY
  abs(epoch_us(ts) - (epoch_us(event_date::TIMESTAMP) + 43200000000)), title) AS k
  FROM granules JOIN storms USING (event_id) WHERE CAST(ts AS DATE) BETWEEN event_date - 1 AND event_date + 1)
SELECT event_id, platform, date, scene_id, ts FROM m WHERE k = 1""", "granules storms")
def nearest_scene(spark, sf):
    scenes = V.granules(spark, sf).select("event_id", "platform", F.col("title").alias("scene_id"), "ts")
    wanted = V.storms(spark, sf).select("event_id", F.col("event_date").alias("date"))
    kinds = V.granules(spark, sf).select("event_id", "platform").distinct()
    return C.nearest_scene(scenes, wanted.join(kinds, "event_id"), ["event_id", "platform"])


@query("granule_resolution", """
, c AS (SELECT event_id, platform, min(CAST(ts AS DATE)) AS pre, max(CAST(ts AS DATE)) AS control, max(orbit_key) AS o FROM granules WHERE cov >= 0.85 GROUP BY ALL),
l AS (SELECT event_id, platform, o, unnest(['pre', 'post', 'control']) AS role, unnest([pre, pre, control]) AS d FROM c),
r AS (SELECT l.event_id, l.platform, role, d, title, cov, row_number() OVER (PARTITION BY l.event_id, l.platform, role ORDER BY g.orbit_key = o DESC, cov DESC, title DESC) AS k
  FROM l JOIN granules g ON g.event_id = l.event_id AND g.platform = l.platform AND CAST(g.ts AS DATE) = d)
SELECT event_id, platform, role, d, title, round(cov, 3) AS cov FROM r WHERE k = 1""", "granules")
def granule_resolution(spark, sf):
    g = V.granules(spark, sf).withColumn("title", F.col("title"))
    day = F.to_date("ts")
    chains = g.where("cov >= 0.85").groupBy("event_id", "platform").agg(
        F.max("orbit_key").alias("rel_orbit"), F.min(day).alias("pre"), F.min(day).alias("post"), F.max(day).alias("control")
    )
    texts = g.withColumn("title", F.lpad(F.col("title").cast("string"), 12, "0"))
    r = C.resolve_granules(texts, chains)
    return r.select("event_id", "platform", "role", "d", F.col("title").cast("bigint").alias("title"), "cov")


# -- screening -------------------------------------------------------------------------------------

_FUNNEL = """
, f AS (SELECT *, year >= 2015 AND area_km2 >= 0.5 AND certainty IN ('High', 'Medium') AS p1, CAST(split_part(date_1, '/', 2) AS INTEGER) BETWEEN 5 AND 9 AS p2,
  lower(type) <> 'snowstorm' AS p3, id NOT IN (7, 42) AS p4, mean_width_m >= 150 AS p5, certainty = 'High' AS p6 FROM catalogue)"""


@query("screening_funnel", _FUNNEL + """
, c AS (SELECT count(*) AS n0, count(*) FILTER (p1) AS n1, count(*) FILTER (p1 AND p2) AS n2, count(*) FILTER (p1 AND p2 AND p3) AS n3, count(*) FILTER (p1 AND p2 AND p3 AND p4) AS n4,
  count(*) FILTER (p1 AND p2 AND p3 AND p4 AND p5) AS n5, count(*) FILTER (p1 AND p2 AND p3 AND p4 AND p5 AND p6) AS n6 FROM f)
SELECT unnest(range(7))::INTEGER AS step_no, unnest(['total', 'base_pool', 'warm', 'non_snow', 'not_processed', 'width', 'high']) AS step,
  unnest([n0, n1, n2, n3, n4, n5, n6]) AS n FROM c""", "catalogue")
def screening_funnel(spark, sf):
    return X.funnel_counts(V.catalogue(spark, sf), X.funnel_steps([7, 42]))


@query("screening_candidates", _FUNNEL + "SELECT id, type, date_1, area_km2 FROM f WHERE p1 AND p2 AND p3 AND p4 AND p5 AND p6", "catalogue")
def screening_candidates(spark, sf):
    return X.candidates(V.catalogue(spark, sf), [7, 42]).select("id", "type", "date_1", "area_km2")


_SCORE = """
, t AS (SELECT *, forest_frac AS tf, CASE quality WHEN 'full' THEN 1.0 WHEN 'stretched' THEN 0.6 WHEN 'partial' THEN 0.3 ELSE 0.0 END::DOUBLE AS tq, least(1.0::DOUBLE, area_km2 / 4) AS ta,
  greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, water_frac * 10)) AS tw, greatest(0.0::DOUBLE, 1 - (slope_mean_deg - 3) / 5) AS ts,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, (mean_width_m - 150) / 350)) AS tm, CASE WHEN wind_gust > 0 THEN least(1.0::DOUBLE, (wind_gust - 15) / 15) ELSE 0.5 END::DOUBLE AS tg,
  CASE WHEN type = 'tornado' THEN 0.05 ELSE 0 END::DOUBLE AS bonus FROM catalogue),
s AS (SELECT *, round(bonus + tf * 0.30::DOUBLE + tq * 0.25::DOUBLE + ta * 0.15::DOUBLE + tw * 0.10::DOUBLE + ts * 0.10::DOUBLE + tm * 0.05::DOUBLE + tg * 0.05::DOUBLE, 3) AS score FROM t)"""


@query("suitability_score", _SCORE + """
SELECT id, score, round(tf * 0.30::DOUBLE, 3) AS forest, round(tq * 0.25::DOUBLE, 3) AS chain, round(ta * 0.15::DOUBLE, 3) AS size, round(tw * 0.10::DOUBLE, 3) AS water,
  round(ts * 0.10::DOUBLE, 3) AS slope, round(tm * 0.05::DOUBLE, 3) AS width, round(tg * 0.05::DOUBLE, 3) AS gust, bonus AS tornado_bonus FROM s""", "catalogue")
def suitability_score(spark, sf):
    return X.scored(V.catalogue(spark, sf)).select("id", "score", "parts.*")


@query("top5_diverse", _SCORE + """
, r AS (SELECT id, type, score, row_number() OVER (PARTITION BY type ORDER BY score DESC, id) AS k FROM s)
SELECT id, type, score FROM r WHERE k <= 3 ORDER BY score DESC, id LIMIT 5""", "catalogue")
def top5_diverse(spark, sf):
    return X.diverse_top(X.scored(V.catalogue(spark, sf))).select("id", "type", "score")


@query("cohort", _SCORE + """
, r AS (SELECT id, type, year, score, row_number() OVER (PARTITION BY type ORDER BY score DESC, id) AS k FROM s
  WHERE quality = 'full' AND year BETWEEN 2015 AND 2017 AND type IN ('tornado', 'squall'))
SELECT id, type, year, score FROM r WHERE k <= CASE type WHEN 'tornado' THEN 3 ELSE 2 END""", "catalogue")
def cohort(spark, sf):
    return X.cohort(X.scored(V.catalogue(spark, sf))).select("id", "type", "year", "score")


@query("planned_jobs", _SCORE + """
, r AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY score DESC, id) AS k FROM s WHERE quality = 'full' AND year BETWEEN 2015 AND 2017 AND type IN ('tornado', 'squall'))
SELECT 'id' || CAST(id AS VARCHAR) || '-coh-' || kind AS name, 10 AS credits FROM r, (SELECT unnest(['prepost', 'control']) AS kind) WHERE k <= CASE type WHEN 'tornado' THEN 3 ELSE 2 END""", "catalogue")
def planned_jobs(spark, sf):
    picked = X.cohort(X.scored(V.catalogue(spark, sf)))
    named = picked.select("id", *[F.concat(F.lit(r + "-"), F.col("id").cast("string")).alias(r) for r in ("pre", "post", "control")])
    return X.planned_jobs(named).select("name", "credits")


@query("landscape", """
, t AS (SELECT grid_id AS event_id, cls, count(*) AS n FROM classes GROUP BY ALL)
SELECT event_id, round(sum(CASE WHEN cls IN (10, 95) THEN n ELSE 0 END) / sum(n), 3) AS forest_frac, round(sum(CASE WHEN cls = 80 THEN n ELSE 0 END) / sum(n), 3) AS water_frac,
  round(sum(CASE WHEN cls = 90 THEN n ELSE 0 END) / sum(n), 3) AS wetland_frac, round(sum(CASE WHEN cls = 40 THEN n ELSE 0 END) / sum(n), 3) AS crop_frac,
  array_to_string(list(CAST(cls AS VARCHAR) || ':' || CAST(n AS VARCHAR) ORDER BY n DESC, cls)[1:4], ',') AS top FROM t GROUP BY event_id""", "classes")
def landscape(spark, sf):
    cells = V.classes(spark, sf).select(F.col("grid_id").alias("event_id"), "cls")
    top = F.array_join(F.transform("classes_top", lambda s: F.concat(s["cls"].cast("string"), F.lit(":"), s["n"].cast("string"))), ",")
    return X.landscape(cells).select("event_id", "forest_frac", "water_frac", "wetland_frac", "crop_frac", top.alias("top"))


@query("updated_candidates", """
SELECT id, type, date FROM catalogue WHERE date >= DATE '2018-01-01' AND type IN ('tornado', 'squall', 'storm') AND (area_km2 * 1000 >= 500 OR (area_km2 * 1000 >= 300 AND id % 2 = 0))""", "catalogue")
def updated_candidates(spark, sf):
    back = F.create_map(*[F.lit(v) for k, n in X.TYPE_NAMES.items() for v in (n, k)])
    new = V.catalogue(spark, sf).select(
        "id", back[F.col("type")].alias("type"), "date", (F.col("area_km2") * 1000).alias("area_ha"), F.when(F.col("id") % 2 == 0, "D").otherwise("M").alias("date_unit")
    )
    both = X.updated_candidates(new).unionByName(X.updated_candidates(new, day_precision=True)).distinct()
    return both.select("id", X.translate(F.col("type")).alias("type"), "date")


@query("priority_list", """
SELECT id, region, regexp_matches(region, 'NATION_1') AS priority, area FROM (SELECT id, region, area_km2 AS area FROM catalogue)
ORDER BY priority DESC, area DESC, id LIMIT 40""", "catalogue")
def priority_list(spark, sf):
    e = V.catalogue(spark, sf).select("id", "region", F.col("area_km2").alias("area"))
    return X.priority_list(e, ["NATION_1", "NOWHERE"]).select("id", "region", "priority", "area")


@query("largest_events", "SELECT id, area_km2 AS area FROM catalogue ORDER BY area_km2 DESC, id LIMIT 25", "catalogue")
def largest_events(spark, sf):
    return X.largest(V.catalogue(spark, sf).select("id", F.col("area_km2").alias("area")), 25)


# -- event tables ----------------------------------------------------------------------------------

@query("crosstab_year_type", """
SELECT CAST(year // 10 * 10 AS VARCHAR) || 's' AS key, count(*) FILTER (type = 'tornado') AS tornado, count(*) FILTER (type = 'squall') AS squall,
  count(*) FILTER (type = 'storm') AS storm FROM catalogue GROUP BY 1""", "catalogue")
def crosstab_year_type(spark, sf):
    return X.crosstab(V.catalogue(spark, sf), X.decade(F.col("year")), "type", ["tornado", "squall", "storm"])


@query("profile", """
, l AS (SELECT unnest(['type', 'region', 'wind_gust', 'area_km2']) AS "column", unnest([type, region, CAST(nullif(wind_gust, -5) AS VARCHAR), CAST(id AS VARCHAR)]) AS value,
  unnest([NULL, NULL, nullif(wind_gust, -5)::DOUBLE, id::DOUBLE]) AS num FROM catalogue)
SELECT "column", count(*) AS n, count(*) - count(value) AS nulls, count(DISTINCT value) AS "distinct", min(num) AS "min", max(num) AS "max" FROM l GROUP BY "column\"""".replace('column\\"', 'column"'), "catalogue")
def profile(spark, sf):
    e = V.catalogue(spark, sf).withColumn("wind_gust", F.nullif("wind_gust", F.lit(-5).cast("bigint"))).withColumn("area_km2", F.col("id"))
    return X.column_profile(e, ["type", "region", "wind_gust", "area_km2"])


@query("value_counts", """
, l AS (SELECT unnest(['type', 'certainty']) AS "column", unnest([type, certainty]) AS value FROM catalogue)
SELECT "column", value, count(*) AS n FROM l GROUP BY ALL""", "catalogue")
def value_counts(spark, sf):
    return X.value_counts(V.catalogue(spark, sf), ["type", "certainty"])


@query("region_top", """
SELECT region, count(*) AS n, round(sum(area_km2), 4) AS area FROM catalogue GROUP BY region ORDER BY sum(area_km2) DESC, region LIMIT 15""", "catalogue")
def region_top(spark, sf):
    e = V.catalogue(spark, sf).select("region", F.col("area_km2").alias("area"))
    return X.region_top(e).withColumn("area", r6("area", 4))


@query("era_totals", """
, e AS (SELECT * FROM catalogue WHERE year >= 2015), l AS (SELECT unnest(['year', 'type', 'certainty']) AS attribute, unnest([CAST(year AS VARCHAR), type, certainty]) AS value, area_km2 FROM e)
SELECT attribute, value, count(*) AS n, round(sum(area_km2) FILTER (area_km2 > 0), 4) AS area_km2 FROM l GROUP BY ALL""", "catalogue")
def era_totals(spark, sf):
    return X.era_totals(V.catalogue(spark, sf), ["year", "type", "certainty"]).withColumn("area_km2", r6("area_km2", 4))


@query("describe_ratio", """
, r AS (SELECT type, forest_frac / nullif(water_frac, 0) AS v FROM catalogue)
SELECT type, count(v) AS "count", round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(min(v), 5) AS "min", round(max(v), 5) AS "max",
  round(quantile_cont(v, 0.25), 5) AS p25, round(median(v), 5) AS p50, round(quantile_cont(v, 0.75), 5) AS p75 FROM r GROUP BY type""", "catalogue")
def describe_ratio(spark, sf):
    e = V.catalogue(spark, sf).withColumn("v", F.try_divide("forest_frac", F.nullif("water_frac", F.lit(0.0))))
    d = X.describe(e, ["type"], "v")
    return d.select("type", "count", *[r6(c, 5).alias(c) for c in ("mean", "std", "min", "max", "p25", "p50", "p75")])


@query("date_range", """
SELECT type, min(date) AS first, max(date) AS last, round(sum(area_km2), 4) AS total FROM catalogue GROUP BY type""", "catalogue")
def date_range(spark, sf):
    return V.catalogue(spark, sf).groupBy("type").agg(F.min("date").alias("first"), F.max("date").alias("last"), r6(F.sum("area_km2"), 4).alias("total"))


@query("found_missing", "SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS found FROM customer")
def found_missing(spark, sf):
    wanted = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    have = V.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return X.found_and_missing(wanted, have, "id")


@query("set_difference", """
SELECT c_custkey AS id, 'left' AS side FROM customer WHERE c_acctbal > 0 AND NOT (c_nationkey < 20)
UNION ALL SELECT c_custkey, 'right' FROM customer WHERE NOT (c_acctbal > 0) AND c_nationkey < 20""")
def set_difference(spark, sf):
    c = V.table(spark, sf, "customer").withColumn("id", F.col("c_custkey"))
    return X.set_difference(c.where("c_acctbal > 0"), c.where("c_nationkey < 20"), "id")


@query("compare_attributes", """
SELECT a.id, a.type AS old_type, b.type AS new_type, CAST(abs(b.date - a.date) AS INTEGER) AS date_shift_days, round(b.area_km2 / nullif(a.area_km2, 0), 6) AS area_ratio,
  a.type = b.type AS same_type, a.date = b.date AS same_date FROM catalogue a LEFT JOIN catalogue b ON b.id = a.id + 1""", "catalogue")
def compare_attributes(spark, sf):
    e = V.catalogue(spark, sf)
    c = X.compare_attributes(e, e.withColumn("id", F.col("id") - 1), "id")
    return c.select("id", "old_type", "new_type", "date_shift_days", r6("area_ratio").alias("area_ratio"), "same_type", "same_date")


@query("key_join", """
SELECT CAST(id AS VARCHAR) || '_' || replace(date_1, '/', '') AS key, type, c_acctbal AS bal FROM catalogue LEFT JOIN customer ON c_custkey = id""", "catalogue")
def key_join(spark, sf):
    e = V.catalogue(spark, sf).withColumn("key", P.event_key(F.col("id"), F.col("date_1")))
    other = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return e.join(other, "id", "left").select("key", "type", "bal")


@query("width_gap_rank", """
, g AS (SELECT region, (1 - (mean_width_m - 50) / mean_width_m) * 100 AS gap, area_km2 AS a FROM catalogue),
r AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY gap) + (count(*) OVER (PARTITION BY region, gap) - 1) / 2 AS x,
  rank() OVER (PARTITION BY region ORDER BY a) + (count(*) OVER (PARTITION BY region, a) - 1) / 2 AS y FROM g)
SELECT region, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY region""", "catalogue")
def width_gap_rank(spark, sf):
    gap = X.width_gap_percent(F.col("mean_width_m") - 50, F.col("mean_width_m"))
    e = V.catalogue(spark, sf).select("region", gap.alias("gap"), F.col("area_km2").alias("a"))
    return order.spearman(e, ["region"], "gap", "a").withColumn("rho", r6("rho"))


# -- scene catalogue -------------------------------------------------------------------------------

_SCENES_SQL = """
WITH s AS (SELECT 's' || CAST(event_id % 4000 AS VARCHAR) AS scene_id, event_id AS pos, ts, CASE event_id % 3 WHEN 0 THEN ['VV', 'VH'] WHEN 1 THEN ['VV'] ELSE [] END AS pols,
  CASE user_id % 3 WHEN 0 THEN 'ascending' WHEN 1 THEN 'descending' ELSE '' END AS orbit, value / 5 - 10 AS x FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY pos) AS k FROM s)"""


def _scenes(spark, sf):
    e = F.col("event_id")
    empty = F.array().cast("array<string>")
    pols = F.when(e % 3 == 0, F.array(F.lit("VV"), F.lit("VH"))).when(e % 3 == 1, F.array(F.lit("VV"))).otherwise(empty)
    x = F.col("value") / 5 - 10
    asset = lambda k: F.struct(F.concat(F.lit("https://x/"), F.lit(k), e.cast("string")).alias("href"))
    some = F.create_map(F.lit("vv"), asset("vv"), F.lit("thumbnail"), asset("t"), F.lit("schema-noise"), asset("n"))
    none = F.create_map(F.lit("B04"), asset("b4"), F.lit("rendered_preview"), asset("r"), F.lit("B08"), asset("b8"))
    props = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("datetime"), F.lit("sentinel-1a").alias("platform"),
        F.when(e % 2 == 0, pols).alias("sar:polarizations"), F.when(e % 2 == 1, pols).alias("polarizations"),
        F.when(F.col("user_id") % 3 == 0, "Ascending").when(F.col("user_id") % 3 == 1, "descending").alias("sat:orbit_state"),
        F.lit(None).cast("string").alias("orbit_direction"), (F.col("user_id") % 175).cast("int").alias("sat:relative_orbit"),
        F.lit(None).cast("int").alias("relative_orbit"),
    )
    items = V.table(spark, sf, "events").select(
        F.lit("page").alias("_file"), e.alias("_pos"), F.concat(F.lit("s"), (e % 4000).cast("string")).alias("id"), F.lit("grd").alias("collection"),
        F.lit(None).cast("string").alias("datetime"), F.array(x, x, x + 5, x + 5).alias("bbox"), props.alias("properties"),
        F.when(e % 2 == 0, some).otherwise(none).alias("assets"),
    )
    return catalogs.stac_scenes(items)


@query("scene_filter", _SCENES_SQL + """
SELECT scene_id, ts, array_to_string(pols, '+') AS pols, orbit FROM f WHERE k = 1 AND x <= 20 AND x + 5 >= 0 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'
  AND (len(pols) = 0 OR len(pols) = 2) AND orbit IN ('', 'ascending')""")
def scene_filter(spark, sf):
    s = catalogs.first_per_id(_scenes(spark, sf))
    kept = catalogs.filter_scenes(s, bbox=[0.0, 0.0, 20.0, 20.0], since="2024-01-05", until="2024-01-25", polarizations=["VV", "VH"], orbit="Ascending")
    return kept.select("scene_id", "ts", F.array_join("polarizations", "+").alias("pols"), F.col("orbit_direction").alias("orbit"))


@query("scene_skips", _SCENES_SQL + """
SELECT count(*) FILTER (k = 1 AND len(pols) <> 1 AND orbit <> 'descending') AS kept, count(*) FILTER (k > 1) AS duplicates, count(*) FILTER (k = 1 AND len(pols) = 1) AS polarization_mismatch,
  count(*) FILTER (k = 1 AND len(pols) <> 1 AND orbit = 'descending') AS orbit_mismatch, count(*) FILTER (k = 1 AND len(pols) = 0) AS polarization_unlisted FROM f""")
def scene_skips(spark, sf):
    return catalogs.skip_counts(_scenes(spark, sf), polarizations=["VV", "VH"], orbit="Ascending")


@query("scene_assets", _SCENES_SQL + """
, a AS (SELECT scene_id, pos % 2 AS odd, pos FROM f WHERE k = 1)
SELECT scene_id, 'vv' AS asset, 'https://x/vv' || CAST(pos AS VARCHAR) AS href FROM a WHERE odd = 0
UNION ALL SELECT scene_id, 'B04', 'https://x/b4' || CAST(pos AS VARCHAR) FROM a WHERE odd = 1 UNION ALL SELECT scene_id, 'B08', 'https://x/b8' || CAST(pos AS VARCHAR) FROM a WHERE odd = 1""")
def scene_assets(spark, sf):
    e = catalogs.split_assets(_scenes(spark, sf))
    first = e.groupBy("scene_id").agg(F.min_by("assets", "_pos").alias("assets"))
    return catalogs.measurement_assets(first)


@query("product_layers", """
SELECT CAST(o_custkey AS VARCHAR) AS product, '/p/' || CAST(o_custkey AS VARCHAR) || '/x_corr.tif' AS coherence,
  CASE WHEN bool_or(o_orderkey % 2 = 0) THEN '/p/' || CAST(o_custkey AS VARCHAR) || '/x_wm.tif' END AS water_mask FROM orders GROUP BY o_custkey""")
def product_layers(spark, sf):
    c = F.col("o_custkey").cast("string")
    kinds = F.array(F.lit("/x_corr.tif"), F.lit("/x_unw.tif"), F.when(F.col("o_orderkey") % 2 == 0, "/x_wm.tif"))
    rows = V.table(spark, sf, "orders").select(c.alias("p"), F.explode(F.array_compact(kinds)).alias("f")).distinct()
    return tables.product_layers(rows.select(F.concat(F.lit("/p/"), "p", "f").alias("path")), F.get(F.split("path", "/"), F.lit(2)))
