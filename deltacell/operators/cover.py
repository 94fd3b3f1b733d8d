"""Polygons as cells, and matching by space and time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltacell.functions import geometry as G
from deltacell.operators.joins import BROADCAST_BYTES, attach, cell_join, salted_join
from deltacell.session import settle, written_bytes

CELL = ["grid_id", "row", "col"]
_BOX = ["xmin", "ymin", "xmax", "ymax"]
#: Days of a period by which dated shapes meet.
PERIOD = 64
#: Events and sites that one task compares at a time.
EVENTS, SITES = 20_000, 5_000


def spans(polygons: DataFrame, ids: Sequence[str], grid: dict, rings: str = "rings") -> DataFrame:
    """Runs of cells whose centre lies inside each polygon: ``ids``, row, c0, c1 (last column included).

    Each polygon edge meets the centre lines of the rows it spans; along a row the sorted meeting
    points pair up into inside spans (even-odd), which never overlap within a row. The work is the
    outline's length, and a large polygon spreads over its rows. Grids are axis-parallel here.
    """
    gt = grid["gt"]
    ids = list(ids)
    parts = polygons.select(*ids, F.explode(rings).alias("_ring"))
    sides = parts.select(*ids, F.explode(G.edges(F.col("_ring"))).alias("_e")).select(*ids, "_e.*")
    # Edge ends in row units measured from row centres.
    v1, v2 = (F.col("y1") - gt[3]) / gt[5] - 0.5, (F.col("y2") - gt[3]) / gt[5] - 0.5
    lo = F.greatest(F.ceil(F.least(v1, v2)).cast("int"), F.lit(0))
    hi = F.least(F.ceil(F.greatest(v1, v2)).cast("int") - 1, F.lit(grid["height"] - 1))
    crossing = (
        sides.withColumn("_v1", v1).withColumn("_v2", v2).withColumn("_lo", lo).withColumn("_hi", hi)
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn("row", F.explode(F.sequence("_lo", "_hi")))
    )
    t = (F.col("row") - F.col("_v1")) / (F.col("_v2") - F.col("_v1"))
    u = (F.col("x1") + t * (F.col("x2") - F.col("x1")) - gt[0]) / gt[1] - 0.5
    w = Window.partitionBy(*ids, "row").orderBy("_u")
    inside = (
        crossing.select(*ids, "row", u.alias("_u"))
        .withColumn("_k", F.row_number().over(w)).withColumn("_end", F.lead("_u").over(w))
        .where(F.col("_k") % 2 == 1)
    )
    c0 = F.greatest(F.ceil("_u").cast("int"), F.lit(0))
    c1 = F.least(F.ceil("_end").cast("int") - 1, F.lit(grid["width"] - 1))
    return inside.select(*ids, "row", c0.alias("c0"), c1.alias("c1")).where("c0 <= c1")


def burn(polygons: DataFrame, ids: Sequence[str], grid: dict, rings: str = "rings") -> DataFrame:
    """Cells whose centre lies inside each polygon: ``ids``, row, col."""
    ids = list(ids)
    return spans(polygons, ids, grid, rings).select(*ids, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def burn_union(polygons: DataFrame, keys: Sequence[str], part: str, grid: dict, rings: str = "rings") -> DataFrame:
    """Cells of a multi-part geometry: parts are burnt apart, so overlaps count once and stay inside."""
    return burn(polygons, [*keys, part], grid, rings).select(*keys, "row", "col").distinct()


def near_events(events: DataFrame, sites: DataFrame, reach: float = 0.15, cell: float = 0.5) -> DataFrame:
    """(site, event) pairs whose bounding boxes meet once the site's is grown by ``reach`` degrees.

    Boxes are cut into ``cell`` sized buckets and meet only there, so no site is compared with
    every event.
    """
    return _meeting(events.select("event_id", *_BOX), sites.select("site_id", *_BOX), [], reach, cell).select("site_id", "event_id")


def _period(d: Column) -> Column:
    return F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / PERIOD)


def _by_period(sites: DataFrame, days: int) -> DataFrame:
    """Each site once for every period ``_p`` that its window, grown by ``days``, touches."""
    first, last = _period(F.date_sub("d1", days)), _period(F.date_add(F.coalesce("d2", "d1"), days))
    dated = sites.withColumn("_p0", first).withColumn("_p1", last).where("_p0 <= _p1")
    return dated.withColumn("_p", F.explode(F.sequence("_p0", "_p1"))).drop("_p0", "_p1")


def near_dated(events: DataFrame, sites: DataFrame, reach: float = 0.15, cell: float = 0.5, days: int = 30) -> DataFrame:
    """The pairs of :func:`near_events` whose event lies within ``days`` of the site (:func:`within_days`).

    Both sides also meet by the period of the date, so pairs of other years are never formed.
    """
    left = _by_period(sites.select("site_id", "d1", "d2", *_BOX), days)
    right = events.select("event_id", "date", *_BOX).withColumn("_p", _period(F.col("date")))
    met = _meeting(right, left, ["_p"], reach, cell)
    return met.where(within_days(F.col("d1"), F.col("d2"), F.col("date"), days)).select("site_id", "event_id")


def _meeting(events: DataFrame, sites: DataFrame, also: list[str], reach: float, cell: float) -> DataFrame:
    """Pairs whose boxes meet and that agree in the columns ``also``, with the other columns of both sides."""
    grown = sites.select(
        *[c for c in sites.columns if c not in _BOX], (F.col("xmin") - reach).alias("_a0"), (F.col("ymin") - reach).alias("_b0"),
        (F.col("xmax") + reach).alias("_a1"), (F.col("ymax") + reach).alias("_b1"),
    )
    left = _buckets(grown, "_a0", "_b0", "_a1", "_b1", cell)
    right = _buckets(events, *_BOX, cell)
    met = salted_join(right, left, ["_bx", "_by", *also], "inner")
    hit = (
        (F.col("_a0") <= F.col("xmax")) & (F.col("_a1") >= F.col("xmin"))
        & (F.col("_b0") <= F.col("ymax")) & (F.col("_b1") >= F.col("ymin"))
    )
    # A pair is kept in the one bucket that holds the lower corner of the common box.
    own_x = F.floor(F.greatest("_a0", "xmin") / cell) == F.col("_bx")
    own_y = F.floor(F.greatest("_b0", "ymin") / cell) == F.col("_by")
    return met.where(hit & own_x & own_y)


def _buckets(df: DataFrame, xmin: str, ymin: str, xmax: str, ymax: str, cell: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    return df.withColumn("_bx", F.explode(span(xmin, xmax))).withColumn("_by", F.explode(span(ymin, ymax)))


def within_days(site_from: Column, site_to: Column, event: Column, days: int = 30) -> Column:
    """Event date inside the site's window grown by ``days`` on each side; a missing end is the start."""
    last = F.coalesce(site_to, site_from)
    return event.between(F.date_sub(site_from, days), F.date_add(last, days))


def overlap(pairs: DataFrame, site_spans: DataFrame, event_spans: DataFrame, cell_m2: float) -> DataFrame:
    """Intersection, union and IoU of matched shapes on a common grid of equal-area cells.

    Shapes are compared as the cells they cover, so the error of an area is at most half the
    cells its outline crosses; both come as the runs of :func:`spans`. Only listed pairs meet, row by
    row, where the common length of their runs is added up: a pair costs the event's rows, not its cells.
    A site that many events touch is spread over its rows.
    """
    size = F.sum(F.col("c1") - F.col("c0") + 1)
    a = site_spans.groupBy("site_id").agg(size.alias("_na"))
    b = event_spans.groupBy("event_id").agg(size.alias("_nb"))
    wanted = pairs.select("site_id", "event_id").distinct()
    left = cell_join(wanted, event_spans.select("event_id", "row", F.col("c0").alias("_b0"), F.col("c1").alias("_b1")), ["event_id"])
    met = cell_join(left, site_spans.select("site_id", "row", F.col("c0").alias("_a0"), F.col("c1").alias("_a1")), ["site_id", "row"])
    common = F.least("_a1", "_b1") - F.greatest("_a0", "_b0") + 1
    shared = met.where(common > 0).groupBy("site_id", "event_id").agg(F.sum(common).alias("_i"))
    out = cell_join(cell_join(cell_join(pairs, shared, ["site_id", "event_id"], "left"), a, ["site_id"], "left"), b, ["event_id"], "left")
    i = F.coalesce(F.col("_i"), F.lit(0))
    union = F.coalesce(F.col("_na"), F.lit(0)) + F.coalesce(F.col("_nb"), F.lit(0)) - i
    return out.withColumn("inter_ha", i * cell_m2 / 1e4).withColumn(
        "iou", F.coalesce(F.try_divide(i, union), F.lit(0.0))
    ).drop("_i", "_na", "_nb")


def _runs(owner: np.ndarray, side: Sequence[np.ndarray], grid: dict) -> list[np.ndarray]:
    """The runs of :func:`spans` as arrays owner, row, c0, c1, from sides x1, y1, x2, y2 and the shape each belongs to."""
    gt, (x1, y1, x2, y2) = grid["gt"], side
    v1, v2 = (y1 - gt[3]) / gt[5] - 0.5, (y2 - gt[3]) / gt[5] - 0.5
    ok = np.isfinite(v1 + v2 + x1 + x2)
    owner, x1, x2, v1, v2 = owner[ok], x1[ok], x2[ok], v1[ok], v2[ok]
    lo = np.maximum(np.ceil(np.minimum(v1, v2)), 0).astype(np.int64)
    hi = np.minimum(np.ceil(np.maximum(v1, v2)) - 1, grid["height"] - 1).astype(np.int64)
    many = np.maximum(hi - lo + 1, 0)
    e = np.repeat(np.arange(len(lo)), many)
    row = lo[e] + np.arange(len(e)) - np.repeat(np.cumsum(many) - many, many)
    t = (row - v1[e]) / (v2[e] - v1[e])
    u = (x1[e] + t * (x2[e] - x1[e]) - gt[0]) / gt[1] - 0.5
    owner = owner[e]
    order = np.lexsort((u, row, owner))
    owner, row, u = owner[order], row[order], u[order]
    new = np.ones(len(u), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(u)) - np.maximum.accumulate(np.where(new, np.arange(len(u)), 0))
    k = np.flatnonzero((at[:-1] % 2 == 0) & ~new[1:])
    c0 = np.maximum(np.ceil(u[k]), 0).astype(np.int64)
    c1 = np.minimum(np.ceil(u[k + 1]) - 1, grid["width"] - 1).astype(np.int64)
    kept = c0 <= c1
    return [x[kept] for x in (owner[k], row[k], c0, c1)]


def _joined(owner, row, c0, c1) -> list[np.ndarray]:
    """Runs of equal columns in rows that follow one another as one block: owner, r0, r1, c0, c1 by owner and r0."""
    order = np.lexsort((row, c1, c0, owner))
    owner, row, c0, c1 = owner[order], row[order], c0[order], c1[order]
    new = np.ones(len(row), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (c0[1:] != c0[:-1]) | (c1[1:] != c1[:-1]) | (row[1:] != row[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1 if len(first) else first
    blocks = [owner[first], row[first], row[last], c0[first], c1[first]]
    order = np.lexsort((blocks[3], blocks[1], blocks[0]))
    return [x[order] for x in blocks]


def blocks(shapes: DataFrame, key: str, grid: dict, rings: str) -> DataFrame:
    """``shapes`` without ``rings``, with the cells each covers as ``_cells``: r0, r1, c0, c1 of disjoint blocks, one after another.

    Blocks are the runs of :func:`spans`, found row by row where the shape lies, so nothing is shuffled. As
    there, rows that share a key are one shape; shapes without cells and rows without a key are left out.
    """
    shapes = shapes.where(F.col(key).isNotNull())
    often = settle(shapes.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(key))
    side = F.broadcast(often) if written_bytes(often) <= BROADCAST_BYTES else often.hint("merge")
    again = shapes.join(side, key, "left_semi")
    whole = again.groupBy(key).agg(F.flatten(F.collect_list(rings)).alias("_rings"))
    alone = shapes.join(side, key, "left_anti").withColumn("_rings", F.col(rings))
    both = alone.unionByName(cell_join(again, whole, [key])).drop(rings)
    sides = F.flatten(F.transform(F.array_compact("_rings"), G.edges))
    both = both.withColumn("_cells", sides).drop("_rings").where("_cells is not null")
    names = [c for c in both.columns if c != "_cells"]

    def run(batches):
        for batch in batches:
            given = batch.column("_cells")
            side = given.flatten()
            owner = np.repeat(np.arange(len(given)), pc.list_value_length(given).to_numpy(zero_copy_only=False))
            points = [x.to_numpy(zero_copy_only=False).astype(float) for x in side.flatten()]
            owner, *corners = _joined(*_runs(owner, points, grid))
            here, n = np.unique(owner, return_counts=True)
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], 4 * np.cumsum(n)]), pa.int32()),
                                             pa.array(np.stack(corners, 1).ravel().astype(np.int32)))
            kept = batch.take(pa.array(here))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), cells], [*names, "_cells"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    return both.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", _cells array<int>")


def _compared(events: pa.Table, sites: pa.Table, cell: float, cell_m2: float, days: int, n: int) -> tuple[np.ndarray, ...]:
    """Row of the site, row of the event, hectares in common and IoU: each site's best ``n`` among these events."""
    def corners(t):
        lists = t.column("_cells").combine_chunks()
        flat = lists.flatten().to_numpy().astype(np.int64).reshape(-1, 4)
        size = lists.value_lengths().to_numpy() // 4
        return flat, np.concatenate([[0], np.cumsum(size)]), (flat[:, 1] - flat[:, 0] + 1) * (flat[:, 3] - flat[:, 2] + 1)

    get = lambda t, *names: [t.column(c).to_numpy() for c in names]
    x0, y0, x1, y1, day = get(events, *_BOX, "_day")
    bx, by = events.column("_bx")[0].as_py(), events.column("_by")[0].as_py()
    blocks_e, first_e, area_e = corners(events)
    owner = np.repeat(np.arange(len(day)), np.diff(first_e))
    total_e = np.bincount(owner, area_e, len(day)).astype(np.int64)
    order = np.empty(len(day), np.int64)
    order[pc.sort_indices(events.column("event_id")).to_numpy()] = np.arange(len(day))
    blocks_s, first_s, area_s = corners(sites)
    out = []
    for s, (a0, b0, a1, b1, d0, d1) in enumerate(zip(*get(sites, "_a0", "_b0", "_a1", "_b1", "_from", "_to"), strict=True)):
        hit = (a0 <= x1) & (a1 >= x0) & (b0 <= y1) & (b1 >= y0) & (day >= d0 - days) & (day <= d1 + days)
        # A pair is kept in the one bucket that holds the lower corner of the common box.
        hit &= (np.floor(np.maximum(a0, x0) / cell) == bx) & (np.floor(np.maximum(b0, y0) / cell) == by)
        near = np.flatnonzero(hit[owner])
        if not len(near):
            continue
        mine = blocks_s[first_s[s]:first_s[s + 1]]
        r0, r1, c0, c1 = blocks_e[near].T
        # Blocks are sorted by their first row: those that can share rows with another lie in one range.
        lo = np.searchsorted(np.maximum.accumulate(mine[:, 1]), r0)
        many = np.maximum(np.searchsorted(mine[:, 0], r1, "right") - lo, 0)
        e = np.repeat(np.arange(len(near)), many)
        m = mine[lo[e] + np.arange(len(e)) - np.repeat(np.cumsum(many) - many, many)]
        rows = np.minimum(r1[e], m[:, 1]) - np.maximum(r0[e], m[:, 0]) + 1
        cols = np.minimum(c1[e], m[:, 3]) - np.maximum(c0[e], m[:, 2]) + 1
        both = np.bincount(owner[near][e], np.maximum(rows, 0) * np.maximum(cols, 0), len(day)).astype(np.int64)
        found = np.flatnonzero(both)
        iou = both[found] / (area_s[first_s[s]:first_s[s + 1]].sum() + total_e[found] - both[found])
        best = np.lexsort((order[found], -iou))[:n]
        out.append((np.full(len(best), s), found[best], both[found[best]] * cell_m2 / 1e4, iou[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2


def matches(sites: DataFrame, events: DataFrame, cell_m2: float, cell: float, days: int = 30, n: int = 6) -> DataFrame:
    """The ``n`` events that cover each site best, as :func:`near_dated`, :func:`overlap` and :func:`best_matches` give them.

    Both sides come from :func:`blocks`. They meet by bucket and period, where a pair is compared at once and
    only a site's best go on, so neither pairs nor their rows are written. What meets in a bucket is dealt into parts of
    about ``EVENTS`` events and ``SITES`` sites.
    """
    epoch = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    site, event = (df.schema[c].dataType.simpleString() for df, c in ((sites, "site_id"), (events, "event_id")))
    boxed = lambda df: df.dropna(subset=_BOX)
    left = _by_period(boxed(sites), days).withColumn("_from", epoch(F.col("d1"))).withColumn("_to", epoch(F.coalesce("d2", "d1")))
    left = left.select("site_id", "_cells", "_p", "_from", "_to", *[F.col(c).alias(a) for c, a in zip(_BOX, ("_a0", "_b0", "_a1", "_b1"), strict=True)])
    right = boxed(events).where("date is not null").withColumn("_p", _period(F.col("date")))
    right = right.select("event_id", "_cells", "_p", epoch(F.col("date")).alias("_day"), *_BOX)
    keys = ["_bx", "_by", "_p"]
    left, right = _buckets(left, "_a0", "_b0", "_a1", "_b1", cell), _buckets(right, *_BOX, cell)
    parts = lambda df, most, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    dealt = settle(parts(right, EVENTS, "_ke").join(parts(left, SITES, "_ks"), keys))

    def spread(df, key, own, mine, other, theirs):
        df = attach(df, dealt, keys, "inner").withColumn(own, F.pmod(F.xxhash64(key), F.col(mine)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs).cast("long") - 1))).drop("_ke", "_ks")

    left = spread(left, "site_id", "_j", "_ks", "_i", "_ke")
    right = spread(right, "event_id", "_i", "_ke", "_j", "_ks")
    keys = [*keys, "_i", "_j"]

    def compare(e: pa.Table, s: pa.Table) -> pa.Table:
        if not (e.num_rows and s.num_rows):
            empty = np.zeros(0, np.int64)
            found = empty, empty, empty.astype(float), empty.astype(float)
        else:
            found = _compared(e, s, cell, cell_m2, days, n)
        return pa.table({"site_id": s.column("site_id").take(pa.array(found[0])), "event_id": e.column("event_id").take(pa.array(found[1])),
                         "inter_ha": pa.array(found[2]), "iou": pa.array(found[3])})

    met = right.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInArrow(
        compare, f"site_id {site}, event_id {event}, inter_ha double, iou double")
    return best_matches(met, n)


def best_matches(matched: DataFrame, n: int = 6) -> DataFrame:
    """Up to ``n`` events per site by overlap, ties by event id."""
    w = Window.partitionBy("site_id").orderBy(F.desc("iou"), "event_id")
    return matched.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def centroid_clusters(parts: DataFrame, bucket: float = 0.5, pad: float = 0.25) -> DataFrame:
    """Densest bucket of each event's parts: summed area, joint bbox, the bbox padded.

    Parts carry event_id, area and a bbox. Halves round to the even bucket.
    """
    at = lambda lo, hi: F.bround((F.col(lo) + F.col(hi)) / 2 / bucket)
    boxes = parts.groupBy("event_id", at("xmin", "xmax").alias("bx"), at("ymin", "ymax").alias("by")).agg(
        F.sum("area").alias("area"), F.count(F.lit(1)).alias("n_parts"), F.min("xmin").alias("xmin"),
        F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
    )
    order = F.struct("area", (-F.col("bx")).alias("tx"), (-F.col("by")).alias("ty"))
    top = boxes.groupBy("event_id").agg(
        F.max_by(F.struct("bx", "by", "area", "n_parts", "xmin", "ymin", "xmax", "ymax"), order).alias("_t"),
        F.sum("n_parts").alias("n_parts_total"),
    ).select("event_id", "n_parts_total", "_t.*")
    return top.select(
        "event_id", "bx", "by", "area", "n_parts", "n_parts_total",
        *[(F.col(c) - pad).alias(c) for c in ("xmin", "ymin")], *[(F.col(c) + pad).alias(c) for c in ("xmax", "ymax")],
    )
