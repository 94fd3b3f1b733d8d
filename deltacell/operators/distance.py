"""Exact Euclidean distance to a mask, in time linear in cells whatever the radius.

Two passes. Along each row, the squared distance to the row's nearest mask cell, as strips of one column
tile. Down each column, the lower envelope of the parabolas that rise from the row's values. Columns are
cut into bands of rows that overlap by the radius, so a task holds a column tile of one band, and the
result does not depend on where bands or tiles end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell.operators.joins import attach

STRIP = 256
#: Rows of a band, unless the radius asks for more: a band overlaps its neighbours by the radius.
BAND = 2048
_FAR = np.int64(1) << 40


def row_strips(reach: int, size: int):
    """Arrow function over one row's mask columns: strips of squared distance that come within ``reach``."""
    def run(key, rows):
        grid, row = (k.as_py() for k in key)
        width = rows.column("width")[0].as_py()
        at = np.unique(rows.column("col").to_numpy())
        out = []
        near = np.zeros(-(-width // size), bool)
        for lo, hi in zip(np.maximum(at - reach, 0) // size, np.minimum(at + reach, width - 1) // size):
            near[lo:hi + 1] = True
        for k in np.flatnonzero(near):
            cols = np.arange(k * size, min((k + 1) * size, width))
            after = np.searchsorted(at, cols)
            right = np.where(after < len(at), at[np.minimum(after, len(at) - 1)] - cols, _FAR)
            left = np.where(after > 0, cols - at[np.maximum(after, 1) - 1], _FAR)
            d = np.minimum(left, right).astype(np.int64)
            out.append((grid, int(row), int(k), np.where(d <= reach, d * d, _FAR).astype("<i8").tobytes()))
        return pa.table({
            "grid_id": pa.array([r[0] for r in out], pa.string()), "row": pa.array([r[1] for r in out], pa.int32()),
            "strip": pa.array([r[2] for r in out], pa.int32()), "squares": pa.array([r[3] for r in out], pa.binary()),
        })

    return run


def envelope(rows: np.ndarray, squares: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Least of ``squares[i] + (wanted - rows[i])^2`` per column, for ascending ``rows`` and ``wanted``.

    All columns are done at once: each keeps a stack of the parabolas on its envelope and where each
    begins to be lowest. A parabola is put on and taken off a stack once.
    """
    n, m = squares.shape
    stack, begins = np.zeros((n, m), np.int64), np.full((n, m), np.inf)
    top = np.full(m, -1)
    every = np.arange(m)
    f, y = squares.astype(np.float64), rows.astype(np.float64)
    for i in range(n):
        cols = every[squares[i] < _FAR]
        begin = np.full(len(cols), -np.inf)
        open_ = np.flatnonzero(top[cols] >= 0)
        while len(open_):
            c = cols[open_]
            k = stack[top[c], c]
            meet = ((f[i, c] + y[i] * y[i]) - (f[k, c] + y[k] * y[k])) / (2 * (y[i] - y[k]))
            beaten = meet <= begins[top[c], c]
            begin[open_[~beaten]] = meet[~beaten]
            top[c[beaten]] -= 1
            open_ = open_[beaten]
            open_ = open_[top[cols[open_]] >= 0]
        top[cols] += 1
        stack[top[cols], cols], begins[top[cols], cols] = i, begin
    out = np.full((len(wanted), m), _FAR)
    at = np.zeros(m, np.int64)
    used = np.flatnonzero(top >= 0)
    for j, w in enumerate(wanted):
        ahead = used
        while len(ahead):
            step = (at[ahead] < top[ahead]) & (begins[np.minimum(at[ahead] + 1, n - 1), ahead] <= w)
            ahead = ahead[step]
            at[ahead] += 1
        k = stack[at[used], used]
        out[j, used] = squares[k, used] + (w - rows[k]) ** 2
    return out


def band_distances(band: int, reach: int, limit: int, size: int):
    """Arrow function over the strips of one band: its own cells at a squared distance of at most ``limit``."""
    def run(key, strips):
        grid, strip, number = (k.as_py() for k in key)
        order = np.argsort(strips.column("row").to_numpy())
        rows = strips.column("row").to_numpy()[order].astype(np.int64)
        values = [np.frombuffer(x, "<i8") for x in strips.column("squares").take(pa.array(order)).to_pylist()]
        height = strips.column("height")[0].as_py()
        first, last = max(number * band, int(rows[0]) - reach), min((number + 1) * band, height, int(rows[-1]) + reach + 1)
        wanted = np.arange(first, max(first, last))
        found = envelope(rows, np.stack(values), wanted)
        r, c = np.nonzero(found <= limit)
        return pa.table({
            "grid_id": pa.array([grid] * len(r), pa.string()), "row": pa.array(wanted[r].astype(np.int32)),
            "col": pa.array((c + strip * size).astype(np.int32)), "d2": pa.array(found[r, c]),
        })

    return run


def squared_distances(mask: DataFrame, grids: DataFrame, radius: float, band: int = BAND, strip: int = STRIP) -> DataFrame:
    """Cells of each grid within ``radius`` cells of its mask: (grid_id, row, col, d2), d2 in cells squared.

    ``grids`` has grid_id, height and width. A cell of the mask has d2 = 0; repeated cells count once. A
    grid without mask cells gives none.
    """
    reach, limit = int(radius), int(np.floor(float(radius) ** 2))
    band = max(band, 2 * reach)
    shaped = attach(mask.select("grid_id", "row", "col"), grids.select("grid_id", "height", "width"), ["grid_id"], "inner")
    heights = grids.select("grid_id", "height")
    strips = shaped.select("grid_id", "row", "col", "width").groupBy("grid_id", "row").applyInArrow(
        row_strips(reach, strip), "grid_id string, row int, strip int, squares binary"
    )
    placed = attach(strips, heights, ["grid_id"], "inner")
    first = F.greatest(F.floor((F.col("row") - reach) / band), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("row") + reach) / band), F.floor((F.col("height") - 1) / band)).cast("int")
    banded = placed.withColumn("band", F.explode(F.sequence(first, last)))
    return banded.groupBy("grid_id", "strip", "band").applyInArrow(
        band_distances(band, reach, limit, strip), "grid_id string, row int, col int, d2 bigint"
    )


def ring(mask: DataFrame, outer: float, grids: DataFrame, inner: float = 0.0) -> DataFrame:
    """Cells farther than ``inner`` and at most ``outer`` cells from the mask, the mask left out."""
    beyond = int(np.floor(float(inner) ** 2)) if inner > 0 else 0
    return squared_distances(mask, grids, outer).where(F.col("d2") > beyond).select("grid_id", "row", "col")
