"""Moving cells between many grids of any CRS and cell size in one job.

Grids are rows, not parameters: ``sources`` and ``targets`` have the columns of ``schema.GRID``, and a
target names the source it is filled from in ``source_id`` (its own ``grid_id`` where that is absent).
Each target grid is cut into tiles, and for each tile the range of source rows and columns that it can
need is computed from projected sample points. Source cells outside every range never move; the others
go to the tiles that need them. Both sides are laid out by the tile's key, so one co-located pass serves
all grids, and a tile of bounded size is what a task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell.functions import geometry as G
from deltacell.functions import planes as P
from deltacell.operators.joins import attach
from deltacell.session import settle

CELL = ["grid_id", "row", "col"]
TILE_KEY = ["grid_id", "tile_row", "tile_col"]
#: Cells along a side of a source tile, and at most along a side of a target tile.
TILE = 256
#: Source cells along a side of what a target tile may need, unless its shortest side needs more.
REACH = 1024
#: Sample points lie this many to a side, and ranges grow by this share of themselves and two cells.
SAMPLES = 4
MARGIN = 0.05
_PAIR = ["grid_id", "source_id", "width", "height", "gt", "epsg", "source_width", "source_height", "source_gt", "source_epsg"]
_WINDOW = ["first_row", "last_row", "first_col", "last_col"]


def pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target grid with its source beside it; a target without its source is an error."""
    named = targets if "source_id" in targets.columns else targets.withColumn("source_id", F.col("grid_id"))
    own = sources.select(
        F.col("grid_id").alias("source_id"), *[F.col(c).alias(f"source_{c}") for c in ("width", "height", "gt", "epsg")]
    )
    both = named.select("grid_id", "source_id", "width", "height", "gt", "epsg").join(own, "source_id", "left")
    lost = F.raise_error(F.concat(F.lit("no source grid for "), F.col("grid_id"))).cast("int")
    return both.select(*_PAIR[:-1], F.when(F.col("source_gt").isNotNull(), F.col("source_epsg")).otherwise(lost).alias("source_epsg"))


def _positions(grid: dict, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where places of a target grid lie in its source; ``grid`` is a row of :func:`pairs`."""
    return P.between(row, col, grid["gt"], grid["epsg"], grid["source_gt"], grid["source_epsg"])


def _sides(tile: int):
    """Tiles of coarse grids have fewer cells, so that what they need stays near ``REACH`` cells to a side."""
    def run(batches):
        for batch in batches:
            sides = []
            for grid in batch.to_pylist():
                middle = np.array([grid["height"] / 2, grid["height"] / 2 + 1]), np.array([grid["width"] / 2, grid["width"] / 2 + 1])
                steps = [abs(float(p[1] - p[0])) for p in _positions(grid, *middle)]
                ratio = max([s for s in steps if np.isfinite(s)], default=1.0)
                sides.append(max(8, min(tile, int(REACH / max(ratio, 1e-9)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sides, pa.int32())], names=[*batch.schema.names, "side"])

    return run


def _ranges(batches):
    """Source ranges of tiles from projected sample points; a point without a place makes it the whole source."""
    for batch in batches:
        rows = batch.to_pylist()
        out = {c: np.full(len(rows), -1, np.int64) for c in _WINDOW}
        by_grid: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            by_grid.setdefault(r["grid_id"], []).append(k)
        for own in by_grid.values():
            grid = rows[own[0]]
            share = np.linspace(0, 1, SAMPLES + 1)
            lines = lambda t, n: np.minimum((np.array([rows[k][t] for k in own])[:, None] + share) * grid["side"], grid[n])  # noqa: E731, B023
            r, c = lines("tile_row", "height"), lines("tile_col", "width")
            shape = (len(own), SAMPLES + 1, SAMPLES + 1)
            at = _positions(grid, np.broadcast_to(r[:, :, None], shape).ravel(), np.broadcast_to(c[:, None, :], shape).ravel())
            lost = ~(np.isfinite(at[0]) & np.isfinite(at[1])).reshape(len(own), -1).all(axis=1)
            for places, size, names in zip(at, ("source_height", "source_width"), (_WINDOW[:2], _WINDOW[2:]), strict=True):
                places = places.reshape(len(own), -1)
                lo, hi = places.min(axis=1), places.max(axis=1)
                room = (hi - lo) * MARGIN + 2
                first = np.where(lost, 0, np.maximum(0, np.floor(lo - room)))
                last = np.where(lost, grid[size] - 1, np.minimum(grid[size] - 1, np.floor(hi + room)))
                out[names[0]][own], out[names[1]][own] = first, np.maximum(last, -1)
        miss = (out["first_row"] > out["last_row"]) | (out["first_col"] > out["last_col"])
        given = [pa.array(out[c].astype(np.int32), mask=miss) for c in _WINDOW]
        yield pa.RecordBatch.from_arrays([*batch.columns, *given], names=[*batch.schema.names, *_WINDOW])


def tile_windows(both: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of each target grid and the source rows and columns each can need (NULL where none)."""
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.select(*_PAIR).schema.fields) + ", side int"
    sided = both.select(*_PAIR).where("width > 0 and height > 0").mapInArrow(_sides(tile), given)
    count = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / F.col("side")).cast("int"))
    tiles = sided.withColumn("tile_row", F.explode(count("height"))).repartition("grid_id", "tile_row")
    tiles = tiles.withColumn("tile_col", F.explode(count("width")))
    return tiles.mapInArrow(_ranges, f"{given}, tile_row int, tile_col int, " + ", ".join(f"{c} int" for c in _WINDOW))


def needed_tiles(windows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per source tile that a window touches: ``source_id``, ``_tr``, ``_tc`` and the columns to keep."""
    every = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / TILE).cast("int"), F.floor(F.col(b) / TILE).cast("int")))
    hit = windows.where("first_row is not null").withColumn("_tr", every("first_row", "last_row"))
    return hit.withColumn("_tc", every("first_col", "last_col")).select("source_id", "_tr", "_tc", *keep)


def _sent(cells: DataFrame, needed: DataFrame, value: str) -> DataFrame:
    """Source cells of needed tiles, once per row of ``needed`` for their tile."""
    own = cells.select(
        F.col("grid_id").alias("source_id"), F.col("row").alias("source_row"), F.col("col").alias("source_col"), F.col(value).cast("double").alias("v"),
        F.floor(F.col("row") / TILE).cast("int").alias("_tr"), F.floor(F.col("col") / TILE).cast("int").alias("_tc"),
    )
    return attach(own, needed, ["source_id", "_tr", "_tc"], "inner")


def _sampler(how: str):
    def run(left, right):
        tiles = left.to_pylist()
        if not tiles:
            return pa.table({"grid_id": pa.array([], pa.string()), "row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), "value": pa.array([], pa.float64())})
        t = tiles[0]
        first = t["tile_row"] * t["side"], t["tile_col"] * t["side"]
        row, col = (a.ravel() for a in np.mgrid[first[0]:min(first[0] + t["side"], t["height"]), first[1]:min(first[1] + t["side"], t["width"])])
        out = np.full(len(row), np.nan)
        if t["first_row"] is not None:
            r0, r1, c0, c1 = (t[c] for c in _WINDOW)
            dense = np.full((r1 - r0 + 1, c1 - c0 + 1), np.nan)
            dense[right.column("source_row").to_numpy() - r0, right.column("source_col").to_numpy() - c0] = right.column("v").to_numpy()
            rows, cols = _positions(t, row + 0.5, col + 0.5)
            known = np.isfinite(rows) & np.isfinite(cols)

            def look(r, c):
                inside = known & (r >= 0) & (r < t["source_height"]) & (c >= 0) & (c < t["source_width"])
                i, j = r[inside].astype(np.int64) - r0, c[inside].astype(np.int64) - c0
                if len(i) and (i.min() < 0 or j.min() < 0 or i.max() >= dense.shape[0] or j.max() >= dense.shape[1]):
                    raise ValueError("a target cell lies outside the source window of its tile")
                got = np.full(len(row), np.nan)
                got[inside] = dense[i, j]
                return got

            if how == "nearest":
                out = look(np.floor(rows), np.floor(cols))
            else:
                snap = lambda a: np.where(np.abs(a - np.round(a)) < 1e-9, np.round(a), a)
                fr, fc = snap(rows - 0.5), snap(cols - 0.5)
                fr0, fc0 = np.floor(fr), np.floor(fc)
                total, weight = np.zeros(len(row)), np.zeros(len(row))
                for dr in (0, 1):
                    for dc in (0, 1):
                        w = np.abs(1 - dr - (fr - fr0)) * np.abs(1 - dc - (fc - fc0))
                        v = look(fr0 + dr, fc0 + dc)
                        use = (w > 0) & ~np.isnan(v)
                        total[use] += w[use] * v[use]
                        weight[use] += w[use]
                out = np.divide(total, weight, out=out, where=weight > 0)
        ids = pa.array([t["grid_id"]] * len(row), pa.string())
        return pa.table({
            "grid_id": ids, "row": pa.array(row.astype(np.int32)), "col": pa.array(col.astype(np.int32)), "value": pa.array(out, mask=np.isnan(out)),
        })

    return run


def _placed(batches):
    """Target cells of source cells, which come with the descriptions of their two grids."""
    described = ["grid_id", "width", "height", "gt", "epsg", "source_gt", "source_epsg"]
    for batch in batches:
        of = np.array(batch.column("grid_id").dictionary_encode().indices.to_numpy())
        row, col = (batch.column(f"source_{c}").to_numpy() + 0.5 for c in ("row", "col"))
        there_row, there_col = np.full(len(of), np.nan), np.full(len(of), np.nan)
        for k in np.unique(of):
            own = np.flatnonzero(of == k)
            g = batch.select(described).slice(int(own[0]), 1).to_pylist()[0]
            r, c = P.between(row[own], col[own], g["source_gt"], g["source_epsg"], g["gt"], g["epsg"])
            inside = np.isfinite(r) & np.isfinite(c) & (r >= 0) & (c >= 0) & (r < g["height"]) & (c < g["width"])
            there_row[own[inside]], there_col[own[inside]] = np.floor(r[inside]), np.floor(c[inside])
        hit = np.flatnonzero(np.isfinite(there_row))
        yield pa.RecordBatch.from_arrays(
            [batch.column("grid_id").take(pa.array(hit)), pa.array(there_row[hit].astype(np.int32)), pa.array(there_col[hit].astype(np.int32)),
             batch.column("v").take(pa.array(hit))],
            names=["grid_id", "row", "col", "v"],
        )


def align(cells: DataFrame, sources: DataFrame, targets: DataFrame, how: str = "nearest", value: str = "value", tile: int = TILE) -> DataFrame:
    """Every cell of every target grid with its value from the source grid: (grid_id, row, col, value).

    ``nearest`` takes the source cell that holds the target's centre (for classes); ``bilinear`` the
    weighted mean of the known ones among the four around it. NULL outside the source or where nothing is
    known. ``cells`` hold at most one row per grid and cell, with NULL or no row where there is no data.
    A grid of no cells gives none.
    """
    if how not in ("nearest", "bilinear"):
        raise ValueError(f"unknown resampling: {how}")
    windows = settle(tile_windows(pairs(sources, targets), tile))
    inside = F.col("source_row").between(F.col("first_row"), F.col("last_row")) & F.col("source_col").between(F.col("first_col"), F.col("last_col"))
    sent = _sent(cells, needed_tiles(windows, [*TILE_KEY, *_WINDOW]), value).where(inside)
    sent = sent.select(*TILE_KEY, "source_row", "source_col", "v")
    # Of the target only tiles move; their cells are made where the tile is.
    asked = windows.select(*_PAIR, "side", "tile_row", "tile_col", *_WINDOW)
    return asked.groupBy(*TILE_KEY).cogroup(sent.groupBy(*TILE_KEY)).applyInArrow(
        _sampler(how), "grid_id string, row int, col int, value double"
    )


def average(cells: DataFrame, sources: DataFrame, targets: DataFrame, value: str = "value", tile: int = TILE) -> DataFrame:
    """Mean of the source cells whose centre falls in each target cell; only occupied cells appear.

    Source cells go to the target grids whose windows touch their tile, and are added up before they move.
    """
    windows = settle(tile_windows(pairs(sources, targets), tile))
    described = ["grid_id", "width", "height", "gt", "epsg", "source_gt", "source_epsg"]
    met = _sent(cells, needed_tiles(windows, described).distinct(), value)
    placed = met.mapInArrow(_placed, "grid_id string, row int, col int, v double")
    return placed.groupBy(*CELL).agg(F.avg("v").alias("value"))


def onto(cells: DataFrame, sources: DataFrame, targets: DataFrame, how: str = "bilinear", value: str = "value", tile: int = TILE) -> DataFrame:
    """Cells on the target grids: those whose grid is the same already pass as they are, the others are aligned.

    ``targets`` share ``grid_id`` with ``sources``. Cells of grids without a target are left out.
    """
    described = lambda t, n: t.select("grid_id", F.struct("width", "height", "gt", "epsg").alias(n))
    both = described(sources, "_s").join(described(targets, "_t"), "grid_id")
    equal = settle(both.select("grid_id", G.same_grid(F.col("_s"), F.col("_t")).alias("_same")))
    kept = attach(cells, equal.where("_same").select("grid_id"), ["grid_id"], "inner").select(*CELL, F.col(value).cast("double").alias("value"))
    other = equal.where("not _same").select("grid_id")
    if other.isEmpty():
        return kept
    need = targets.join(other, "grid_id", "left_semi")
    return kept.union(align(cells, sources, need, how, value, tile))
