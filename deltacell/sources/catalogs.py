"""Catalogue documents (JSON dumps) as tables, with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltacell.functions import dates as D
from deltacell.functions import geometry as G
from deltacell.functions import naming as N
from deltacell.operators.joins import cell_join
from deltacell.session import settle

_STAC = (
    "features ARRAY<STRUCT<id: STRING, collection: STRING, datetime: STRING, bbox: ARRAY<DOUBLE>, "
    "properties: STRUCT<`datetime`: STRING, platform: STRING, `sar:polarizations`: ARRAY<STRING>, "
    "polarizations: ARRAY<STRING>, `sat:orbit_state`: STRING, orbit_direction: STRING, "
    "`sat:relative_orbit`: INT, relative_orbit: INT>, assets: MAP<STRING, STRUCT<href: STRING>>>>"
)
_CMR = (
    "feed STRUCT<entry: ARRAY<STRUCT<title: STRING, time_start: STRING, polygons: ARRAY<ARRAY<STRING>>, "
    "orbit_calculated_spatial_domains: ARRAY<STRUCT<orbit_number: STRING>>, "
    "attributes: ARRAY<STRUCT<name: STRING, value: STRING>>>>>, "
    "items ARRAY<STRUCT<umm: STRUCT<GranuleUR: STRING, "
    "TemporalExtent: STRUCT<RangeDateTime: STRUCT<BeginningDateTime: STRING>>, "
    "SpatialExtent: STRUCT<HorizontalSpatialDomain: STRUCT<Geometry: STRUCT<GPolygons: ARRAY<STRUCT<Boundary: "
    "STRUCT<Points: ARRAY<STRUCT<Latitude: DOUBLE, Longitude: DOUBLE>>>>>>>>>>>"
)


def _site_schema(id_fields: Sequence[str]) -> str:
    ids = ", ".join(f"`{n}`: INT" for n in id_fields)
    return (
        "features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>, properties: STRUCT<"
        f"{ids}, year: INT, type: STRING, status: STRING, date: STRING, date_1: STRING, date_2: STRING, "
        "area_km2: DOUBLE>>>"
    )


def read_stac(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of the dumped pages, property names with or without their prefix."""
    items = spark.read.schema(_STAC).json(path, multiLine=True).select(
        F.input_file_name().alias("_file"), F.posexplode("features").alias("_pos", "_f")
    )
    return stac_scenes(items.select("_file", "_pos", "_f.*"))


def stac_scenes(items: DataFrame) -> DataFrame:
    p = F.col("properties")
    listed = F.coalesce(F.nullif(p["sar:polarizations"], F.array().cast("array<string>")), p["polarizations"])
    listed = F.coalesce(listed, F.array().cast("array<string>"))
    return items.select(
        "_file", "_pos", F.col("id").alias("scene_id"),
        F.coalesce(p["datetime"], F.col("datetime")).try_cast("timestamp").alias("ts"),
        F.coalesce(p["platform"], F.lit("sentinel-1")).alias("platform"),
        F.transform(listed, lambda c: F.upper(c)).alias("polarizations"),
        F.lower(F.coalesce(F.nullif(p["sat:orbit_state"], F.lit("")), p["orbit_direction"], F.lit(""))).alias("orbit_direction"),
        F.coalesce(p["sat:relative_orbit"], p["relative_orbit"]).alias("relative_orbit"),
        "bbox", "collection",
        F.transform_values(F.map_filter("assets", lambda k, v: F.coalesce(v["href"], F.lit("")) != ""), lambda k, v: v["href"]).alias("assets"),
    )


def split_assets(scenes: DataFrame) -> DataFrame:
    """Preview links apart from data assets; the rendered preview wins over a thumbnail."""
    is_preview = lambda k: F.lower(k).isin(*N.PREVIEW_KEYS)
    previews = F.map_filter("assets", lambda k, v: is_preview(k))
    rank = F.array_sort(F.transform(F.map_entries(previews), lambda e: F.struct(
        F.when(F.lower(e["key"]) == "rendered_preview", 0).otherwise(1).alias("r"), e["key"].alias("k"), e["value"].alias("v")
    )))
    thumb = F.map_values(F.map_filter(previews, lambda k, v: F.lower(k) == "thumbnail"))
    return (
        scenes.withColumn("preview_url", F.get(F.transform(rank, lambda e: e["v"]), F.lit(0)))
        .withColumn("thumbnail_url", F.get(thumb, F.lit(0)))
        .withColumn("assets", F.map_filter("assets", lambda k, v: ~is_preview(k)))
    )


def measurement_assets(scenes: DataFrame) -> DataFrame:
    """One row per asset to use: the channel assets of a scene, or all of them if it has none."""
    named = F.map_filter("assets", lambda k, v: F.lower(k).isin(*N.MEASURE_KEYS))
    chosen = F.when(F.size(F.map_keys(named)) > 0, named).otherwise(F.col("assets"))
    return scenes.select("scene_id", F.explode(chosen).alias("asset", "href"))


def first_per_id(scenes: DataFrame) -> DataFrame:
    """The first row of each scene id in page order; rows without an id are all kept."""
    rest = [c for c in scenes.columns if c not in ("scene_id", "_file", "_pos")]
    known = scenes.where(F.coalesce("scene_id", F.lit("")) != "")
    kept = known.groupBy("scene_id").agg(F.min_by(F.struct(*rest), F.struct("_file", "_pos")).alias("_s"))
    kept = kept.select("scene_id", *[F.col(f"_s.{c}").alias(c) for c in rest])
    return kept.unionByName(scenes.where(F.coalesce("scene_id", F.lit("")) == "").select("scene_id", *rest))


def scene_rules(
    bbox: Sequence[float] | None = None, since: str | None = None, until: str | None = None,
    polarizations: Sequence[str] = (), orbit: str | None = None,
) -> dict[str, Column]:
    """Named filters of a scene table; a scene that does not say its channels or orbit is kept."""
    yes = F.lit(True)
    b = F.col("bbox")
    rules = {
        "bbox": yes if bbox is None else (
            (b[0] <= bbox[2]) & (b[2] >= bbox[0]) & (b[1] <= bbox[3]) & (b[3] >= bbox[1])
        ),
        "date": (yes if since is None else F.col("ts") >= F.lit(since).cast("timestamp"))
        & (yes if until is None else F.col("ts") <= F.lit(until).cast("timestamp")),
        "polarization": yes if not polarizations else (
            (F.size("polarizations") == 0)
            | (F.size(F.array_except(F.array(*[F.lit(p) for p in polarizations]), F.col("polarizations"))) == 0)
        ),
        "orbit": yes if not orbit or orbit == "Any" else (
            (F.coalesce("orbit_direction", F.lit("")) == "") | (F.col("orbit_direction") == orbit.lower())
        ),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def filter_scenes(scenes: DataFrame, **wanted) -> DataFrame:
    for rule in scene_rules(**wanted).values():
        scenes = scenes.where(rule)
    return scenes


def skip_counts(scenes: DataFrame, **wanted) -> DataFrame:
    """Kept scenes and the reason of each skip: duplicate, channels missing or unlisted, orbit."""
    rules = scene_rules(**wanted)
    unlisted = (F.size("polarizations") == 0) if wanted.get("polarizations") else F.lit(False)
    judged = scenes.select(
        "scene_id", "_file", "_pos",
        F.struct(rules["polarization"].alias("pol"), rules["orbit"].alias("orb"), unlisted.alias("bare")).alias("_s"),
    )
    # Copies of one scene shrink to its first row and a count before anything is shuffled.
    known = F.coalesce("scene_id", F.lit("")) != ""
    named = judged.where(known).groupBy("scene_id").agg(
        F.min_by("_s", F.struct("_file", "_pos")).alias("_s"), F.count(F.lit(1)).alias("n")
    ).select("_s.*", "n")
    firsts = named.unionByName(judged.where(~known).select("_s.*", F.lit(1).cast("bigint").alias("n")))
    pol, orb = F.col("pol"), F.col("orb")
    return firsts.agg(
        F.count_if(pol & orb).alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(~pol).alias("polarization_mismatch"), F.count_if(pol & ~orb).alias("orbit_mismatch"),
        F.count_if(F.col("bare")).alias("polarization_unlisted"),
    )


def read_cmr(spark: SparkSession, path: str) -> DataFrame:
    """Granules of both dump layouts: title, ts, platform, mode, orbit key, direction, ring readings.

    Only SLC granules stay.
    """
    pages = spark.read.schema(_CMR).json(path, multiLine=True)
    direction = F.filter("e.attributes", lambda a: F.lower(a["name"]).contains("scend") | F.lower(a["name"]).isin("ascdesc", "asc_desc"))
    letter = F.upper(F.substring(F.trim(F.get(direction, F.lit(0))["value"]), 1, 1))
    feed = pages.select(F.explode("feed.entry").alias("e")).select(
        F.col("e.title").alias("title"), F.col("e.time_start").alias("start"),
        F.get("e.orbit_calculated_spatial_domains", F.lit(0))["orbit_number"].try_cast("int").alias("orbit"),
        F.when(letter == "A", "ASC").when(letter == "D", "DESC").alias("direction"),
        G.parse_ring(F.get(F.get("e.polygons", F.lit(0)), F.lit(0))).alias("rings"),
    )
    points = F.flatten(F.transform(
        "u.SpatialExtent.HorizontalSpatialDomain.Geometry.GPolygons", lambda g: g["Boundary"]["Points"]
    ))
    ring = F.transform(points, lambda p: F.struct(p["Longitude"].alias("x"), p["Latitude"].alias("y")))
    items = pages.select(F.explode("items.umm").alias("u")).select(
        F.col("u.GranuleUR").alias("title"), F.col("u.TemporalExtent.RangeDateTime.BeginningDateTime").alias("start"),
        F.lit(None).cast("int").alias("orbit"), F.lit(None).cast("string").alias("direction"),
        F.struct(ring.alias("as_given"), F.lit(None).cast(ring_type()).alias("swapped")).alias("rings"),
    )
    return granules(feed.unionByName(items))


def ring_type() -> str:
    return "array<struct<x:double,y:double>>"


def granules(raw: DataFrame) -> DataFrame:
    """Typed granule rows from title, start, orbit, direction and rings."""
    title = F.col("title")
    mode = F.when(title.contains("_IW_"), "IW").when(title.contains("_EW_"), "EW").otherwise("SM")
    ts = F.try_to_timestamp(F.substring("start", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    orbit = F.coalesce(F.col("orbit"), N.split_slc(title)["abs_orbit"])
    return raw.where(title.contains("_SLC__")).select(
        "title", ts.alias("ts"), F.when(title.startswith("S1B_"), "S1B").otherwise("S1A").alias("platform"),
        mode.alias("mode"), (orbit % 175).alias("orbit_key"), "direction", "rings",
    ).where(F.col("ts").isNotNull()).withColumn(
        "track_key", F.coalesce(F.col("orbit_key").cast("string"), D.time_bucket(F.col("ts")))
    )


def coverage(granule_rows: DataFrame, hulls: DataFrame, pad: float = 0.05) -> DataFrame:
    """Share of each event's hull a granule covers.

    ``granule_rows`` carry event_id; ``hulls``: event_id, hull (convex, counter-clockwise). Of the
    two ring readings the one that overlaps the hull's box, ``pad`` degrees wider, counts. Shapes are cut once
    for each pair of different shapes, however many granules and events share them, and not at all where
    their boxes lie apart.
    """
    b = F.col("_b")
    box = [b["xmin"] - pad, b["ymin"] - pad, b["xmax"] + pad, b["ymax"] + pad]
    named = lambda c: F.coalesce(F.sha2(F.to_json(c), 256), F.lit(""))
    given = settle(granule_rows.withColumn("_g", named(F.col("rings"))))
    shapes = settle(hulls.select("event_id", F.col("hull").alias("_h"), named(F.struct("hull")).alias("_k")))
    met = cell_join(given, shapes.select("event_id", "_k"), ["event_id"])
    each = lambda df, key, c: df.groupBy(key).agg(F.first(c).alias(c))
    pairs = met.select("_g", "_k").distinct()
    pairs = cell_join(cell_join(pairs, each(given, "_g", "rings"), ["_g"]), each(shapes, "_k", "_h"), ["_k"])
    pairs = pairs.withColumn("_b", G.rings_bbox(F.array("_h")))
    own = lambda r: G.rings_bbox(F.array(F.col("rings")[r]))
    apart = lambda a: (a["xmin"] > b["xmax"]) | (a["xmax"] < b["xmin"]) | (a["ymin"] > b["ymax"]) | (a["ymax"] < b["ymin"])
    none = lambda r: F.col("rings")[r].isNull() | F.coalesce(apart(own(r)), F.lit(False))
    ring = G.pick_ring_reading(F.col("rings"), *box)
    share = F.coalesce(G.hull_coverage(ring, F.col("_h")), F.lit(0.0))
    pairs = pairs.repartition("_g", "_k").withColumn("cov", F.when(none("as_given") & none("swapped"), 0.0).otherwise(share))
    return cell_join(met, settle(pairs.select("_g", "_k", "cov")), ["_g", "_k"]).drop("_g", "_k").select(*granule_rows.columns, "cov")


def read_sites(
    spark: SparkSession, path: str, years: Mapping[int, int] | None = None, id_fields: Sequence[str] = ("id",)
) -> DataFrame:
    """Site features: id under the first of ``id_fields`` that is set, year with a fallback map, rings."""
    raw = spark.read.schema(_site_schema(id_fields)).json(path, multiLine=True).select(F.explode("features").alias("f"))
    p = F.col("f.properties")
    site = F.coalesce(*[F.nullif(p[n], F.lit(0)) for n in id_fields])
    year = F.coalesce(p["year"], F.year(D.parse_date(p["date_1"])), F.year(D.parse_date(p["date"])))
    if years:
        pairs = F.create_map(*[F.lit(v) for kv in years.items() for v in kv])
        year = F.coalesce(year, pairs[site])
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    single = F.from_json(text, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = F.transform(F.when(kind == "Polygon", single).otherwise(multi), lambda r: F.transform(
        r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))
    ))
    return raw.select(
        site.alias("id"), year.alias("year"), p["type"].alias("type"), p["status"].alias("status"),
        D.parse_date(p["date_1"]).alias("date_1"), D.parse_date(p["date_2"]).alias("date_2"),
        D.parse_date(p["date"]).alias("date"), p["area_km2"].alias("area_km2"), rings.alias("rings"),
    )
