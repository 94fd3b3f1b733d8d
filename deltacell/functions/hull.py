"""Convex hull of a geometry already held in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half(points: Column) -> Column:
    """One side of the hull: a fold over sorted points that keeps left turns only; its last point is left out."""
    def add(chain: Column, p: Column) -> Column:
        def turns_left(k: Column) -> Column:
            a, b = F.get(chain, k - 2), F.get(chain, k - 1)
            return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]) > 0

        # The chain is convex, so what must go is its end: the last place with a left turn stays.
        kept = F.array_max(F.filter(F.sequence(F.lit(1), F.size(chain)), lambda k: (k == 1) | turns_left(k)))
        return F.concat(F.slice(chain, F.lit(1), kept), F.array(p))

    n = F.size(points)
    chain = F.aggregate(F.slice(points, F.lit(2), n), F.slice(points, F.lit(1), F.lit(1)), add)
    return F.slice(chain, F.lit(1), F.size(chain) - 1)


def convex_hull(rings: Column | str) -> Column:
    """Counter-clockwise hull ring of all vertices of ``ARRAY<ARRAY<STRUCT<x,y>>>``; fewer than three points stay as they are."""
    double = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    points = F.array_sort(F.array_distinct(F.transform(F.flatten(rings), double)))
    return F.when(F.size(points) < 3, points).otherwise(F.concat(_half(points), _half(F.reverse(points))))
