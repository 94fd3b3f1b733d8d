"""The test tables laid out as cell tables, catalogues and event tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stack(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("g"), F.floor(k / 1000).cast("string")).alias("grid_id"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("scene_id"),
        F.when(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz"), "pre").otherwise("post").alias("period"),
        F.when(F.col("l_returnflag") == "A", "VV").when(F.col("l_returnflag") == "N", "VH").otherwise("HH").alias("band"),
        F.floor((k % 1000) / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"),
        F.col("l_extendedprice").alias("value"),
    )


def raw_field(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding component as a cell, none missing."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("g"), F.floor(F.col("vec_id") / 250).cast("string")).alias("grid_id"),
        (F.col("vec_id") % 250).cast("int").alias("row"), "label", F.posexplode("embedding").alias("col", "_v"),
    ).select("grid_id", "row", "col", F.col("_v").cast("double").alias("value"), "label")


def field(spark: SparkSession, sf: str, limit: float = 0.25) -> DataFrame:
    """Dense cells, NULL where the component is large."""
    raw = raw_field(spark, sf)
    return raw.select("grid_id", "row", "col", F.when(F.abs("value") < limit, F.col("value")).alias("value"))


def sparse_field(spark: SparkSession, sf: str) -> DataFrame:
    """About 69 % missing."""
    return field(spark, sf, 0.05)


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Two coherence layers per cell."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    e = table(spark, sf, "embeddings").select(
        "vec_id", "label", half.alias("half"), F.explode(F.sequence(F.lit(0), half - 1)).alias("col"), "embedding"
    )
    at = lambda i: (F.get("embedding", i).cast("double") + 1) / 2
    return e.select(
        F.concat(F.lit("g"), F.floor(F.col("vec_id") / 250).cast("string")).alias("grid_id"),
        (F.col("vec_id") % 250).cast("int").alias("row"), "col", at(F.col("col")).alias("target"),
        at(F.col("col") + F.col("half")).alias("control"), "label",
    )


def coherence(spark: SparkSession, sf: str) -> DataFrame:
    """The two layers as rows with a role."""
    role = lambda n: F.struct(F.lit(n).alias("role"), F.col(n).alias("value"))
    return layers(spark, sf).select(
        "grid_id", "row", "col", F.explode(F.array(role("target"), role("control"))).alias("_r")
    ).select("grid_id", "row", "col", "_r.role", "_r.value")


def classes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("g"), F.floor(k / 1000).cast("string")).alias("grid_id"),
        F.floor((k % 1000) / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"),
        (F.col("p_size") % 10 * 10).alias("cls"), (F.col("p_size") * 2).alias("cover"), (F.col("p_size") % 25).alias("loss"),
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with ties and a class per cell."""
    return raw_field(spark, sf).select(
        "grid_id", "row", "col", F.round("value", 3).alias("score"), (F.col("label") < 3).alias("positive"), "label"
    )


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Event table: one order is one storm event."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.add_months(F.to_date("o_orderdate"), 240)
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kinds = {"1-URGENT": "tornado", "2-HIGH": "squall", "3-MEDIUM": "storm", "4-NOT SPECIFIED": "Snowstorm"}
    kind = F.lit("snowfall")
    for value, name in kinds.items():
        kind = F.when(F.col("o_orderpriority") == value, name).otherwise(kind)
    quality = F.get(F.array(*map(F.lit, ("full", "stretched", "partial", "none"))), (k % 4).cast("int"))
    return joined.select(
        k.alias("id"), kind.alias("type"),
        F.when(F.col("o_orderstatus") == "F", "High").when(F.col("o_orderstatus") == "O", "Medium").otherwise("Low").alias("certainty"),
        day.alias("date"), F.year(day).alias("year"), F.date_format(day, "yyyy/MM/dd").alias("date_1"),
        (F.col("o_totalprice") / 1e5).alias("area_km2"), F.col("n_name").alias("region"),
        (k % 400 + 100).alias("mean_width_m"), (c % 40 - 5).alias("wind_gust"), quality.alias("quality"),
        ((c % 101) / 100).alias("forest_frac"), ((k % 13) / 100).alias("water_frac"), ((c % 17) / 2).alias("slope_mean_deg"),
    )


def granules(spark: SparkSession, sf: str) -> DataFrame:
    """Acquisitions: the events' times stretched tenfold, so a track repeats every few weeks."""
    start = 1704067200000000
    user = F.col("user_id")
    return table(spark, sf, "events").select(
        user.alias("event_id"), F.col("event_type").alias("platform"), F.lit("IW").alias("mode"),
        (user % 175).alias("orbit_key"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) * 10 - 9 * start).alias("ts"),
        (1 - F.col("value") / 1000).alias("cov"), F.col("event_id").alias("title"),
    )


def storms(spark: SparkSession, sf: str) -> DataFrame:
    """One storm per user, on a day of its own."""
    return table(spark, sf, "events").select(F.col("user_id").alias("event_id")).distinct().withColumn(
        "event_date", F.date_add(F.lit("2024-01-20").cast("date"), (F.col("event_id") * 7 % 250).cast("int"))
    )


def diamonds(spark: SparkSession, sf: str) -> DataFrame:
    """One polygon per supplier on the field's 64 x 250 grid of 10 m cells."""
    k = F.col("s_suppkey")
    cx, cy = (k * 37 % 640) + 0.37, (k * 53 % 2500) + 0.21
    rx, ry = F.lit(40.3) + k % 60, F.lit(30.7) + k % 90
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(cx - rx, cy), p(cx, cy + ry), p(cx + rx, cy + 5.3), p(cx, cy - ry))
    return table(spark, sf, "supplier").select(k.alias("poly_id"), F.array(ring).alias("rings"))

SQL_VIEWS = {
    "stack": """
SELECT 'g' || CAST(l_partkey // 1000 AS VARCHAR) AS grid_id, 's' || CAST(l_suppkey % 10 AS VARCHAR) AS scene_id,
  CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 'pre' ELSE 'post' END AS period,
  CASE l_returnflag WHEN 'A' THEN 'VV' WHEN 'N' THEN 'VH' ELSE 'HH' END AS band,
  CAST((l_partkey % 1000) // 50 AS INTEGER) AS "row", CAST(l_partkey % 50 AS INTEGER) AS col, l_extendedprice AS value
FROM lineitem""",
    "db": """
SELECT *, CASE WHEN value > 0 THEN 10 * log10(value) END AS v FROM stack""",
    "raw_field": """
SELECT 'g' || CAST(vec_id // 250 AS VARCHAR) AS grid_id, CAST(vec_id % 250 AS INTEGER) AS "row",
  CAST(i - 1 AS INTEGER) AS col, CAST(v AS DOUBLE) AS value, label
FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings)""",
    "field": """
SELECT grid_id, "row", col, CASE WHEN abs(value) < 0.25 THEN value END AS value FROM raw_field""",
    "sparse_field": """
SELECT grid_id, "row", col, CASE WHEN abs(value) < 0.05 THEN value END AS value FROM raw_field""",
    "layers": """
SELECT 'g' || CAST(vec_id // 250 AS VARCHAR) AS grid_id, CAST(vec_id % 250 AS INTEGER) AS "row", CAST(c AS INTEGER) AS col,
  (CAST(embedding[c + 1] AS DOUBLE) + 1) / 2 AS target, (CAST(embedding[c + 1 + len(embedding) // 2] AS DOUBLE) + 1) / 2 AS control, label
FROM (SELECT *, unnest(range(len(embedding) // 2)) AS c FROM embeddings)""",
    "classes": """
SELECT 'g' || CAST(p_partkey // 1000 AS VARCHAR) AS grid_id, CAST((p_partkey % 1000) // 50 AS INTEGER) AS "row",
  CAST(p_partkey % 50 AS INTEGER) AS col, p_size % 10 * 10 AS cls, p_size * 2 AS cover, p_size % 25 AS loss FROM part""",
    "samples": """
SELECT grid_id, "row", col, round(value, 3) AS score, label < 3 AS positive, label FROM raw_field""",
    "catalogue": """
SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'tornado' WHEN '2-HIGH' THEN 'squall'
    WHEN '3-MEDIUM' THEN 'storm' WHEN '4-NOT SPECIFIED' THEN 'Snowstorm' ELSE 'snowfall' END AS type,
  CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Medium' ELSE 'Low' END AS certainty,
  CAST(o_orderdate + INTERVAL 240 MONTH AS DATE) AS date, year(o_orderdate + INTERVAL 240 MONTH) AS year,
  strftime(o_orderdate + INTERVAL 240 MONTH, '%Y/%m/%d') AS date_1, o_totalprice / 1e5 AS area_km2, n_name AS region,
  o_orderkey % 400 + 100 AS mean_width_m, o_custkey % 40 - 5 AS wind_gust,
  ['full', 'stretched', 'partial', 'none'][o_orderkey % 4 + 1] AS quality, (o_custkey % 101) / 100 AS forest_frac,
  (o_orderkey % 13) / 100 AS water_frac, (o_custkey % 17) / 2 AS slope_mean_deg
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "granules": """
SELECT user_id AS event_id, event_type AS platform, 'IW' AS mode, user_id % 175 AS orbit_key,
  make_timestamp(epoch_us(ts) * 10 - 9 * 1704067200000000) AS ts, 1 - value / 1000 AS cov, event_id AS title FROM events""",
    "storms": """
SELECT DISTINCT user_id AS event_id, DATE '2024-01-20' + CAST(user_id * 7 % 250 AS INTEGER) AS event_date FROM events""",
    "diamonds": """
SELECT s_suppkey AS poly_id, (s_suppkey * 37 % 640) + CAST(0.37 AS DOUBLE) AS cx, (s_suppkey * 53 % 2500) + CAST(0.21 AS DOUBLE) AS cy,
  CAST(40.3 AS DOUBLE) + s_suppkey % 60 AS rx, CAST(30.7 AS DOUBLE) + s_suppkey % 90 AS ry FROM supplier""",
    "diamond_points": """
SELECT poly_id, unnest([1, 2, 3, 4]) AS i, unnest([cx - rx, cx, cx + rx, cx]) AS x,
  unnest([cy, cy + ry, cy + CAST(5.3 AS DOUBLE), cy - ry]) AS y FROM diamonds""",
    "diamond_sides": """
SELECT a.poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
FROM diamond_points a JOIN diamond_points b ON a.poly_id = b.poly_id AND b.i = a.i % 4 + 1""",
    "burnt": """
SELECT poly_id, "row", col FROM (
  SELECT d.poly_id, r AS "row", c AS col, s.x1, s.y1, s.x2, s.y2, c * 10.0 + 5 AS x, 2500 - (r * 10.0 + 5) AS y
  FROM diamonds d JOIN range(250) t(r) ON 2500 - (r * 10 + 5) BETWEEN d.cy - d.ry AND d.cy + d.ry
  JOIN range(64) u(c) ON c * 10 + 5 BETWEEN d.cx - d.rx AND d.cx + d.rx JOIN diamond_sides s ON s.poly_id = d.poly_id)
WHERE (y1 <= y) <> (y2 <= y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
GROUP BY poly_id, "row", col HAVING count(*) % 2 = 1""",
    "deltas": """
SELECT grid_id, "row", col,
  median(v) FILTER (band = 'VV' AND period = 'post') - median(v) FILTER (band = 'VV' AND period = 'pre') AS d_VV,
  median(v) FILTER (band = 'VH' AND period = 'post') - median(v) FILTER (band = 'VH' AND period = 'pre') AS d_VH
FROM db WHERE band IN ('VV', 'VH') GROUP BY grid_id, "row", col""",
    "wi": """
SELECT grid_id, "row", col, d_VV + d_VH AS value FROM deltas""",
}
