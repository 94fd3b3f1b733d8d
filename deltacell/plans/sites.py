"""From an event database to a cohort of study sites, and comparison of two databases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell.functions import dates as D
from deltacell.functions import geometry as G
from deltacell.functions.hull import convex_hull
from deltacell.operators import chains as C
from deltacell.operators import cover
from deltacell.operators import screening as X
from deltacell.operators.joins import cell_join, salted_join
from deltacell.session import settle
from deltacell.sources import catalogs


def event_key(event_id, date_text):
    return F.concat(event_id.cast("string"), F.lit("_"), F.replace(date_text, F.lit("/"), F.lit("")))


def _box_buckets(box, cell: float):
    """Bucket numbers a box touches, as an array of structs."""
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    return F.flatten(F.transform(span(box["xmin"], box["xmax"]), lambda x: F.transform(
        span(box["ymin"], box["ymax"]), lambda y: F.struct(x.alias("x"), y.alias("y"))
    )))


def site_funnel(
    events: DataFrame, granules: DataFrame, landscape: DataFrame, processed: Sequence[int] = (), n: int = 5, per_type: int = 3,
    cell: float = 2.0,
) -> dict[str, DataFrame]:
    """Candidates, their best chain, their score, and the top picks.

    ``events`` follow the event schema with a ``geom``; ``granules`` come from the catalogue
    reader; ``landscape`` is keyed by event_id. Granules and events meet by day and by ``cell``
    degree bucket of their boxes, so neither side is compared with all of the other. Events of one
    date and hull have one chain, so it is sought once for all of them.
    """
    pool = X.candidates(events, processed).withColumn("event_date", D.parse_date(F.col("date_1")))
    pool = settle(pool.withColumn("event_id", event_key(F.col("id"), F.col("date_1"))))
    shapes = pool.where("event_id is not null").select("event_id", F.struct("event_date", convex_hull("geom").alias("hull")).alias("_s"))
    shapes = shapes.groupBy("event_id").agg(F.sort_array(F.collect_set("_s")).alias("_s"))
    members = settle(shapes.withColumn("_spot", F.sha2(F.to_json(F.struct("_s")), 256)))
    # From here to the chains, event_id names a spot: a date and hull that any number of events share.
    spots = members.groupBy(F.col("_spot").alias("event_id")).agg(F.first("_s").alias("_s"))
    hulls = settle(spots.select("event_id", F.explode("_s").alias("_s")).select("event_id", "_s.*"))
    boxes = hulls.select("event_id", "event_date", G.rings_bbox(F.array("hull")).alias("_b")).select("event_id", "event_date", "_b.*")
    before, after = C.WINDOW_DAYS
    days = F.explode(F.sequence(F.date_sub("event_date", before), F.date_add("event_date", after)))
    wanted = boxes.withColumn("_k", F.explode(_box_buckets(F.struct("xmin", "ymin", "xmax", "ymax"), cell)))
    wanted = wanted.select("event_id", "_k", days.alias("_d"))
    readings = F.array_compact(F.array("rings.as_given", "rings.swapped"))
    seen = F.flatten(F.transform(readings, lambda r: _box_buckets(G.rings_bbox(F.array(r)), cell)))
    placed = granules.withColumn("_d", F.to_date("ts")).withColumn("_k", F.explode(F.array_distinct(seen)))
    met = salted_join(placed.select("title", "_d", "_k"), wanted, ["_d", "_k"], "inner", salts=4)
    met = granules.join(met.select("event_id", "title").distinct(), "title")
    covered = catalogs.coverage(met, hulls.drop("event_date")).withColumn("orbit_key", F.col("track_key"))
    chains = C.select_chains(covered, boxes.select("event_id", "event_date")).withColumnRenamed("event_id", "_spot")
    chains = settle(cell_join(members.select("event_id", "_spot"), settle(chains), ["_spot"]).drop("_spot"))
    joined = pool.drop("event_date").join(chains, "event_id").join(landscape, "event_id", "left")
    scored = X.scored(joined)
    return {"pool": pool, "chains": chains, "scored": scored, "top": X.diverse_top(scored, n, per_type)}


def site_matches(
    sites: DataFrame, events: DataFrame, site_rings: str, event_rings: str, grid: dict, cell_m2: float, n: int = 6, bucket: float = 0.5
) -> DataFrame:
    """Events overlapping each site in space and within thirty days of it, best overlap first.

    ``sites``: site_id, d1, d2, bbox columns, rings. ``events``: event_id, date, bbox columns,
    rings. Boxes and dates find the pairs, cells of ``grid`` decide. Columns: site_id, event_id,
    inter_ha, iou, rank.
    """
    shaped = lambda df, key, rings, *names: cover.blocks(
        df.select(key, *names, "xmin", "ymin", "xmax", "ymax", F.col(rings).alias("_r")), key, grid, "_r")
    a = shaped(sites, "site_id", site_rings, "d1", "d2")
    b = shaped(events, "event_id", event_rings, "date")
    return cover.matches(settle(a), settle(b), cell_m2, bucket, n=n)


def compare_databases(old: DataFrame, new: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Record-wise comparison, found and missing ids, and the spread of the area ratio."""
    rows = settle(X.compare_attributes(old, new, key))
    return {
        "rows": rows,
        "found": X.found_and_missing(old, new, key),
        "ratio": X.describe(rows.withColumn("_all", F.lit("all")), ["_all"], "area_ratio").drop("_all"),
    }
