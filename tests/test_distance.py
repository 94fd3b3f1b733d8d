import numpy as np
import pandas as pd
import pytest

from deltacell.operators import distance as D


def brute(a, radius):
    rows, cols = np.nonzero(a)
    out = {}
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            d = ((rows - r) ** 2 + (cols - c) ** 2).min() if len(rows) else None
            if d is not None and d <= radius * radius:
                out[r, c] = int(d)
    return out


@pytest.mark.parametrize("radius, band, strip", [(3.5, 4, 8), (1000, 16, 16), (9, 5, 7), (0, 8, 8)])
def test_distances(spark, radius, band, strip):
    rng = np.random.default_rng(int(radius))
    arrays = {"a": rng.random((41, 53)) < 0.01, "b": np.zeros((30, 20), bool), "c": rng.random((17, 9)) < 0.3}
    arrays["b"][0, 0] = arrays["b"][29, 19] = True
    parts = [pd.DataFrame({"grid_id": k, "row": np.nonzero(a)[0].astype("int32"), "col": np.nonzero(a)[1].astype("int32")}) for k, a in arrays.items()]
    mask = spark.createDataFrame(pd.concat([*parts, parts[0].head(5)]))
    grids = spark.createDataFrame([(k, *a.shape) for k, a in arrays.items()] + [("none", 5, 5)], "grid_id string, height int, width int")
    got = D.squared_distances(mask, grids, radius, band, strip).toPandas()
    for k, a in arrays.items():
        own = got[got.grid_id == k]
        assert {(r, c): d for r, c, d in zip(own.row, own.col, own.d2)} == brute(a, radius) and len(own) == len(brute(a, radius))


def test_envelope_equals_the_least_parabola():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, m = int(rng.integers(1, 30)), 6
        rows = np.sort(rng.choice(60, n, replace=False)).astype(np.int64)
        squares = np.where(rng.random((n, m)) < 0.4, D._FAR, rng.integers(0, 40, (n, m)) ** 2).astype(np.int64)
        wanted = np.arange(-5, 70)
        got = D.envelope(rows, squares, wanted)
        every = squares[None] + (wanted[:, None, None] - rows[None, :, None]) ** 2
        want = np.where(squares[None] < D._FAR, every, D._FAR).min(axis=1)
        assert (np.minimum(got, D._FAR) == np.minimum(want, D._FAR)).all()


def test_ring(spark):
    a = np.zeros((60, 60), bool)
    a[30, 30] = a[5, 50] = True
    mask = spark.createDataFrame(pd.DataFrame({"grid_id": "g", "row": np.nonzero(a)[0].astype("int32"), "col": np.nonzero(a)[1].astype("int32")}))
    grids = spark.createDataFrame([("g", 60, 60)], "grid_id string, height int, width int")
    d = brute(a, 100)
    for outer, inner in ((12, 0), (12.5, 4), (90, 25)):
        got = {(r.row, r.col) for r in D.ring(mask, outer, grids, inner).collect()}
        assert got == {k for k, v in d.items() if inner * inner < v <= outer * outer}
