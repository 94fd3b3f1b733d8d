"""8-connected objects of a sparse mask.

Cells are labelled inside their tile first; only tile-border contacts become graph edges. The
graph is far smaller than the mask, a huge object contributes one node per tile, and no step
gathers an object's cells: sizes add up per tile part.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltacell.functions import geometry as G
from deltacell.functions import planes as P
from deltacell.operators.focal import TILE, tile_of
from deltacell.operators.joins import attach, cell_join, salted_join
from deltacell.session import settle

CELL = ["grid_id", "row", "col"]
_ROW_STEP = 1 << 31

# The task helpers below travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cell_code(row: Column, col: Column) -> Column:
    """One number per cell, growing in reading order."""
    return row.cast("bigint") * F.lit(_ROW_STEP) + col.cast("bigint")


def _label_tile(t: pa.Table) -> pa.Table:
    """Smallest cell code of each connected part of one tile (at most TILE x TILE cells), each cell once."""
    code, at = np.unique(t["row"].to_numpy().astype(np.int64) * _ROW_STEP + t["col"].to_numpy(), return_index=True)
    first = np.ones(len(code), bool)
    first[1:] = code[1:] != code[:-1] + 1
    run = np.cumsum(first) - 1
    start = code[first]
    end = code[np.append(np.flatnonzero(first)[1:] - 1, len(code) - 1)]
    lo = np.searchsorted(end, start + _ROW_STEP - 1)
    hi = np.searchsorted(start, end + _ROW_STEP + 1, side="right")
    parent = np.arange(len(start))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(hi > lo):
        for j in range(lo[i], hi[i]):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(start))], dtype=np.int64)
    return t.select(CELL).take(pa.array(at)).append_column("part", pa.array(start[roots][run]))


def tile_parts(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Each mask cell with the label of its connected part inside its tile."""
    cells = mask.select(*CELL).withColumn("_tr", tile_of("row", tile)).withColumn("_tc", tile_of("col", tile))
    return cells.groupBy("grid_id", "_tr", "_tc").applyInArrow(
        _label_tile, "grid_id string, row int, col int, part bigint"
    )


def border_contacts(parts: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of parts that touch across a tile border: (grid_id, child, parent) with child > parent."""
    row, col = F.col("row"), F.col("col")
    top, left = row % tile == 0, col % tile == 0
    bottom, right = row % tile == tile - 1, col % tile == tile - 1
    rim = parts.where(top | left | bottom | right).select(*CELL, "part")
    step = lambda dr, dc, when: F.when(when, F.struct((row + dr).alias("r"), (col + dc).alias("c")))
    ahead = F.array_compact(F.array(
        step(0, 1, right), step(1, 0, bottom), step(1, 1, bottom | right), step(1, -1, bottom | left)
    ))
    tried = rim.select("grid_id", F.col("part").alias("_a"), F.explode(ahead).alias("_n")).select(
        "grid_id", "_a", F.col("_n.r").alias("row"), F.col("_n.c").alias("col")
    )
    met = tried.join(rim, CELL).where(F.col("_a") != F.col("part"))
    return met.select(
        "grid_id", F.greatest("_a", "part").alias("child"), F.least("_a", "part").alias("parent")
    ).distinct()


def contract(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (grid_id, child, parent).

    Two linking steps per round until every child has one parent that is no child itself: each
    node's children move to the smallest node it knows, then each node's own links do. Rounds grow
    with the logarithm of the longest path. Every round is written out, so a lost executor costs
    one round at most.
    """
    links = settle(edges)
    while not _settled(links):
        best = links.groupBy("grid_id", "child").agg(F.min("parent").alias("_m"))
        up = salted_join(links, best.withColumnRenamed("child", "parent"), ["grid_id", "parent"])
        links = up.select("grid_id", "child", F.coalesce("_m", "parent").alias("parent")).distinct()
        best = links.groupBy("grid_id", "child").agg(F.min("parent").alias("_m"))
        pairs = F.array(
            F.struct("child", F.col("_m").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("_m").alias("parent"))
        )
        both = salted_join(links, best, ["grid_id", "child"], "inner").select("grid_id", F.explode(pairs).alias("_e"))
        links = settle(both.select("grid_id", "_e.*").where(F.col("child") > F.col("parent")).distinct())
    return links


def _settled(links: DataFrame) -> bool:
    """Every child has a single parent, and no parent is a child."""
    ends = F.array(
        F.struct(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )
    nodes = links.select("grid_id", F.explode(ends).alias("_e")).groupBy("grid_id", "_e.node").agg(
        F.sum("_e.up").alias("up"), F.max("_e.down").alias("down")
    )
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Mask cells with ``label`` (smallest cell code of the object) and ``part`` (that of its tile part)."""
    parts = settle(tile_parts(mask, tile))
    links = contract(border_contacts(parts, tile)).select("grid_id", F.col("child").alias("part"), F.col("parent").alias("_root"))
    joined = cell_join(parts, links, ["grid_id", "part"], "left")
    return joined.select(*CELL, F.coalesce("_root", "part").alias("label"), "part")


def object_stats(labelled: DataFrame, cell_area: Column | float) -> DataFrame:
    """Cells, hectares and extent per object; parts are summed before they meet."""
    area = cell_area if isinstance(cell_area, Column) else F.lit(float(cell_area))
    parts = labelled.groupBy("grid_id", "label", "part").agg(
        F.count(F.lit(1)).alias("n_px"), F.sum(area).alias("_a"), F.min("row").alias("row_min"),
        F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"),
    )
    return parts.groupBy("grid_id", "label").agg(
        F.sum("n_px").alias("n_px"), (F.sum("_a") / 1e4).alias("area_ha"), F.min("row_min").alias("row_min"),
        F.max("row_max").alias("row_max"), F.min("col_min").alias("col_min"), F.max("col_max").alias("col_max"),
    )


def remove_small(labelled: DataFrame, min_pixels: int) -> DataFrame:
    """Objects of at least ``min_pixels`` cells; 1 or less keeps everything."""
    if min_pixels <= 1:
        return labelled
    parts = labelled.groupBy("grid_id", "label", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("grid_id", "label").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pixels)
    kept = salted_join(parts.select("grid_id", "label", "part"), sizes.select("grid_id", "label"), ["grid_id", "label"], "inner")
    return cell_join(labelled, kept.select("grid_id", "part"), ["grid_id", "part"], "left_semi").select(*labelled.columns)


# -- outlines --------------------------------------------------------------------------------

def _heading(p: tuple[int, int], q: tuple[int, int]) -> tuple[int, int]:
    return ((q[0] > p[0]) - (q[0] < p[0]), (q[1] > p[1]) - (q[1] < p[1]))


def _trace(runs: np.ndarray) -> list[list[tuple[int, int]]]:
    """Rings of one object from its directed straight runs of cell sides, rows of (r0, c0, r1, c1)."""
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r0, c0, r1, c1 in runs.tolist():
        ahead.setdefault((r0, c0), []).append((r1, c1))
    rings = []
    for origin in sorted(ahead):
        while origin in ahead:
            here, ring, heading, opening = origin, [], None, _heading(origin, ahead[origin][0])
            while True:
                options = ahead[here]
                # Where two cells touch at a corner, turn away from the inside to stay on one object.
                left = None if heading is None else (-heading[1], heading[0])
                step = next((o for o in options if _heading(here, o) == left), options[0])
                options.remove(step)
                if not options:
                    del ahead[here]
                ring.append(here)
                heading, here = _heading(here, step), step
                if here == origin and (origin not in ahead or (-heading[1], heading[0]) == opening):
                    break
            rings.append(ring)
    return rings


def _tracer(gt: list[float]):
    """Task function over rows sorted by object; an object may span batches."""
    keys, ends = ["grid_id", "label"], ["r0", "c0", "r1", "c1"]

    def text(ring):
        points = (f"{gt[0] + c * gt[1]:.10g} {gt[3] + r * gt[5]:.10g}" for r, c in [*ring, ring[0]])
        return "(" + ", ".join(points) + ")"

    def row(key, held):
        rings = _trace(np.concatenate(held))
        return (*key, len(rings), "POLYGON (" + ", ".join(map(text, rings)) + ")")

    def run(batches):
        key, held = None, []
        for pdf in batches:
            done = []
            ids = pdf[keys]
            cuts = np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy())
            values = pdf[ends].to_numpy(np.int64)
            for at, stop in zip(cuts, [*cuts[1:], len(pdf)]):
                here = tuple(ids.iloc[at])
                if here != key and held:
                    done.append(row(key, held))
                    held = []
                key = here
                held.append(values[at:stop])
            yield pd.DataFrame(done, columns=[*keys, "n_rings", "wkt"])
        if held:
            yield pd.DataFrame([row(key, held)], columns=[*keys, "n_rings", "wkt"])

    return run


def cell_sides(labelled: DataFrame) -> DataFrame:
    """Directed sides of the mask's outline with the inside on the right hand.

    Two cells that share a side always belong to one object, so a side is on the outline exactly
    when the neighbour is not in the mask.
    """
    wr = Window.partitionBy("grid_id", "row").orderBy("col")
    wc = Window.partitionBy("grid_id", "col").orderBy("row")
    row, col = F.col("row"), F.col("col")
    far = lambda c, d, w, base: F.coalesce(c(base).over(w) != F.col(base) + d, F.lit(True))
    seen = (
        labelled.withColumn("_w", far(F.lag, -1, wr, "col")).withColumn("_e", far(F.lead, 1, wr, "col"))
        .withColumn("_n", far(F.lag, -1, wc, "row")).withColumn("_s", far(F.lead, 1, wc, "row"))
    )
    ends = {"_n": (0, 0, 0, 1), "_e": (0, 1, 1, 1), "_s": (1, 1, 1, 0), "_w": (1, 0, 0, 0)}
    side = lambda k: F.when(F.col(k), F.struct(
        *[(base + d).alias(n) for n, base, d in zip(("r0", "c0", "r1", "c1"), (row, col, row, col), ends[k])]
    ))
    return seen.select("grid_id", "label", F.explode(F.array_compact(F.array(*[side(k) for k in ends]))).alias("_x")).select(
        "grid_id", "label", "_x.*"
    )


def straight_runs(sides: DataFrame) -> DataFrame:
    """Sides joined where they go on in one direction, so that only corners are left."""
    along = F.col("r0") == F.col("r1")
    line, at = F.when(along, F.col("r0")).otherwise(F.col("c0")), F.when(along, F.least("c0", "c1")).otherwise(F.least("r0", "r1"))
    turned = sides.select("grid_id", "label", (F.col("r1") - F.col("r0")).alias("dr"), (F.col("c1") - F.col("c0")).alias("dc"),
                          line.alias("line"), at.alias("at"))
    key = ["grid_id", "label", "dr", "dc", "line"]
    numbered = turned.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*key).orderBy("at")))
    runs = numbered.groupBy(*key, "run").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
    flat, ahead = F.col("dr") == 0, (F.col("dr") + F.col("dc")) > 0
    begin, end = F.when(ahead, F.col("lo")).otherwise(F.col("hi")), F.when(ahead, F.col("hi")).otherwise(F.col("lo"))
    place = lambda x, own: F.when(flat == own, x).otherwise(F.col("line"))
    return runs.select("grid_id", "label", place(begin, F.lit(False)).alias("r0"), place(begin, F.lit(True)).alias("c0"),
                       place(end, F.lit(False)).alias("r1"), place(end, F.lit(True)).alias("c1"))


def _line_integrals(batches):
    """What each straight run adds to its object's area on the equal-area plane, by the trapezoid under it."""
    for batch in batches:
        of = batch.column("grid_id").dictionary_encode().indices.to_numpy()
        ends = [batch.column(c).to_numpy().astype(np.float64) for c in ("r0", "c0", "r1", "c1")]
        out = np.zeros(batch.num_rows)
        for k in np.unique(of):
            own = np.flatnonzero(of == k)
            gt, epsg = (batch.column(c)[int(own[0])].as_py() for c in ("gt", "epsg"))
            (x0, y0), (x1, y1) = (P.reproject(*P.place(gt, ends[i][own], ends[i + 1][own]), epsg, 6933) for i in (0, 2))
            out[own] = (x1 - x0) * (y0 + y1) / 2
        yield pa.RecordBatch.from_arrays([batch.column("grid_id"), batch.column("label"), pa.array(out)], names=["grid_id", "label", "m2"])


def equal_area(labelled: DataFrame, grids: DataFrame) -> DataFrame:
    """Area of every object on the equal-area plane: (grid_id, label, area_m2).

    The corners of its outline are converted and integrated along, holes with the opposite sign; runs
    are added up before they meet, so no ring is put together and no task holds an object.
    """
    runs = attach(straight_runs(cell_sides(labelled)), grids.select("grid_id", "gt", "epsg"), ["grid_id"], "inner")
    added = runs.select("grid_id", "label", "r0", "c0", "r1", "c1", "gt", "epsg").mapInArrow(_line_integrals, "grid_id string, label bigint, m2 double")
    return added.groupBy("grid_id", "label").agg(F.abs(F.sum("m2")).alias("area_m2"))


def measured(labelled: DataFrame, grids: DataFrame, min_pixels: int = 0) -> DataFrame:
    """Size and extent per object with its area on the equal-area plane.

    Objects of less area than ``min_pixels`` cells of their grid are left out; 0 or less keeps all.
    """
    sizes = object_stats(labelled, 0.0).drop("area_ha").join(equal_area(labelled, grids), ["grid_id", "label"])
    cell = grids.select("grid_id", G.cell_area_m2(F.col("gt"), F.col("epsg")).alias("_cell"))
    kept = attach(sizes, cell, ["grid_id"], "inner").where(F.col("area_m2") >= F.lit(max(min_pixels, 0)) * F.col("_cell"))
    return kept.withColumn("area_ha", F.col("area_m2") / 1e4).drop("_cell", "area_m2")


def ring_points(labelled: DataFrame) -> DataFrame:
    """Corners of every outline in order: (grid_id, label, ring, place, r, c), rows and columns of corners.

    Each straight run knows the run it goes on in. Pointers are then doubled, round by round: a run
    learns the smallest run within the next 1, 2, 4, ... of its ring and how far ahead that is. When no
    run learns of a smaller one, the smallest names the ring, and the steps to it give the place. So a
    ring of any length is put in order by joins in which every run occurs once, and none is held by a task.
    """
    key = ["grid_id", "label"]
    down, ahead = F.signum(F.col("r1") - F.col("r0")), F.signum(F.col("c1") - F.col("c0"))
    head = F.when(ahead > 0, 0).when(down > 0, 1).when(ahead < 0, 2).otherwise(3)
    runs = straight_runs(cell_sides(labelled)).withColumn("head", head)
    runs = settle(runs.withColumn("id", cell_code(F.col("r0"), F.col("c0")) * 4 + F.col("head")))
    # Where two cells touch at a corner, turn away from the inside to stay on one object.
    forks = F.count(F.lit(1)).over(Window.partitionBy(*key, "r0", "c0"))
    starts = runs.select(*key, F.col("r0").alias("r1"), F.col("c0").alias("c1"), F.col("id").alias("ptr"), F.col("head").alias("_h"), forks.alias("_n"))
    next_ = runs.select(*key, "id", "head", "r1", "c1").join(starts, [*key, "r1", "c1"]).where("_n = 1 or _h = (head + 3) % 4")
    state = settle(next_.select("grid_id", "id", "ptr", F.col("id").alias("low"), F.lit(0).cast("long").alias("off")))
    width = 1
    while True:
        far = state.select("grid_id", F.col("id").alias("ptr"), F.col("ptr").alias("_p"), F.col("low").alias("_l"), F.col("off").alias("_o"))
        met = state.join(far, ["grid_id", "ptr"])
        lower = F.col("_l") < F.col("low")
        state = settle(met.select(
            "grid_id", "id", F.col("_p").alias("ptr"), F.least("low", "_l").alias("low"),
            F.when(lower, F.col("_o") + F.lit(width).cast("long")).otherwise(F.col("off")).alias("off"), lower.alias("lower"),
        ))
        width *= 2
        if state.where("lower").isEmpty():
            break
    length = state.groupBy("grid_id", "low").agg((F.max("off") + 1).alias("_len"))
    placed = state.select("grid_id", "id", "low", "off").join(length, ["grid_id", "low"])
    ordered = placed.select("grid_id", "id", F.col("low").alias("ring"), ((F.col("_len") - F.col("off")) % F.col("_len")).alias("place"))
    return runs.select(*key, "id", "r0", "c0").join(ordered, ["grid_id", "id"]).select(
        *key, "ring", "place", F.col("r0").alias("r"), F.col("c0").alias("c")
    )


def _texts(points: DataFrame, gt: list[float]) -> DataFrame:
    """One polygon per object from its ordered corners."""
    at = lambda p: F.format_string("%s %s", *[
        F.regexp_replace(F.format_string("%.8f", v.cast("double")), r"\.?0+$", "") for v in (gt[0] + p["c"] * gt[1], gt[3] + p["r"] * gt[5])
    ])
    ring = F.array_sort(F.collect_list(F.struct("place", "r", "c")))
    rings = points.groupBy("grid_id", "label", "ring").agg(ring.alias("_p"))
    text = F.concat(F.lit("("), F.array_join(F.transform(F.concat("_p", F.slice("_p", 1, 1)), at), ", "), F.lit(")"))
    told = rings.select("grid_id", "label", F.struct("ring", text.alias("text")).alias("_r"))
    every = F.array_sort(F.collect_list("_r"))
    joined = F.concat(F.lit("POLYGON ("), F.array_join(F.transform(every, lambda r: r["text"]), ", "), F.lit(")"))
    return told.groupBy("grid_id", "label").agg(F.count(F.lit(1)).cast("int").alias("n_rings"), joined.alias("wkt"))


def outlines(labelled: DataFrame, gt: list[float], task_corners: int = 200_000) -> DataFrame:
    """WKT per object: (grid_id, label, n_rings, wkt), one polygon whatever its size.

    Sides become straight runs first. Objects of up to ``task_corners`` runs are traced where their runs
    meet; the rings of larger ones are put in order by :func:`ring_points`, with the same result.
    """
    keys = ["grid_id", "label"]
    runs = settle(straight_runs(cell_sides(labelled)))
    counts = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    huge = settle(counts.where(F.col("_n") > task_corners).select(*keys))
    small = runs if huge.isEmpty() else runs.join(huge, keys, "left_anti")
    rows = small.repartition(*keys).sortWithinPartitions(*keys)
    traced = rows.mapInPandas(_tracer(gt), "grid_id string, label bigint, n_rings int, wkt string")
    if huge.isEmpty():
        return traced
    return traced.union(_texts(ring_points(labelled.join(huge, keys, "left_semi")), gt))
