import numpy as np
import pytest

from deltacell.operators import focal


def brute(a, k, fn, mode="edge"):
    r = k // 2
    p = np.pad(a, r, mode=mode)
    return np.array([[fn(p[i : i + k, j : j + k]) for j in range(a.shape[1])] for i in range(a.shape[0])])


def mean_rule(w, share=0.30):
    ok = np.isfinite(w)
    return w[ok].mean() if ok.mean() >= share and ok.any() else np.nan


def holes(seed, shape=(23, 17), share=0.3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=shape)
    a[rng.random(shape) < share] = np.nan
    return a


@pytest.mark.parametrize("size", [3, 5])
@pytest.mark.parametrize("tile", [8, 256])
def test_median_filter(cells, array, size, tile):
    a = holes(3)
    with np.errstate(all="ignore"):
        want = np.where(np.isfinite(a), brute(a, size, np.nanmedian), np.nan)
    np.testing.assert_allclose(array(focal.median_filter(cells(a), size, tile), a.shape), want, atol=1e-12)
    np.testing.assert_allclose(array(focal.filtered(cells(a), size, 1, tile=tile), a.shape), want, atol=1e-12)


@pytest.mark.parametrize("share", [0.05, 0.75])
def test_box_mean(cells, array, share):
    a = holes(5, share=share)
    want = brute(a, 5, mean_rule)
    np.testing.assert_allclose(array(focal.box_mean(cells(a), 5, tile=8), a.shape), want, atol=1e-12)
    np.testing.assert_allclose(array(focal.filtered(cells(a), 1, 5, tile=8), a.shape), want, atol=1e-12)


def test_filter_chain_does_not_depend_on_tiles(spark, cells):
    a = holes(7, (31, 29), 0.1)
    limit = spark.createDataFrame([("g", 0.05)], "grid_id string, threshold double")
    runs = [
        {(r["row"], r["col"], round(r["value"], 9)) for r in focal.threshold_map(cells(a), limit, 3, 5, tile=t, arrow=w).collect()}
        for t, w in ((7, True), (256, True), (7, False), (256, False))
    ]
    assert runs[0] and runs[0] == runs[1] == runs[2] == runs[3]


def test_spike_and_null(cells, array):
    a = np.full((9, 9), 2.0)
    a[4, 4], a[0, 0] = 50.0, np.nan
    out = array(focal.median_filter(cells(a), 3), a.shape)
    assert np.isnan(out[0, 0]) and out[4, 4] == 2.0
    with pytest.raises(ValueError):
        focal.median_filter(cells(a), 4)


def test_majority(cells, array):
    rng = np.random.default_rng(2)
    a = (rng.random((15, 12)) > 0.5).astype(float)
    want = brute(a, 3, lambda w: float(w.sum() * 2 > 9))
    np.testing.assert_array_equal(array(focal.majority_filter(cells(a), 3, tile=5), a.shape), want)


@pytest.mark.parametrize("mode", ["reference", "lee"])
def test_lee(cells, array, mode):
    a = holes(11, (20, 14), 0.1)

    def one(w):
        v = w[np.isfinite(w)]
        n = max(len(v), 1)
        return v.sum() / n, (v**2).sum() / n

    r = 2
    p = np.pad(a, r, mode="symmetric")
    m = np.array([[one(p[i : i + 5, j : j + 5]) for j in range(a.shape[1])] for i in range(a.shape[0])])
    mean, var = m[..., 0], np.maximum(m[..., 1] - m[..., 0] ** 2, 0)
    ratio = var / (var + np.nanvar(a) + 1e-10)
    w = ratio if mode == "reference" else 1 - ratio
    want = np.where(np.isfinite(a), w * mean + (1 - w) * a, mean)
    np.testing.assert_allclose(array(focal.lee_filter(cells(a), 5, mode, tile=8), a.shape), want, atol=1e-9)
    flat = np.full((6, 6), 17.5)
    np.testing.assert_allclose(array(focal.lee_filter(cells(flat), 3), flat.shape), flat)


def test_closing(cells, array):
    rng = np.random.default_rng(4)
    a = (rng.random((20, 20)) > 0.85).astype(float)
    d = brute(a, 3, np.max, "constant")
    e = brute(d, 3, np.min, "constant")
    np.testing.assert_array_equal(array(focal.binary_closing(cells(a), 3, tile=6), a.shape), e)


def test_slope(cells, array):
    a = np.random.default_rng(6).normal(size=(12, 9))
    gy, gx = np.gradient(a)
    want = np.degrees(np.arctan(np.hypot(gx / 30.0, gy / 20.0)))
    np.testing.assert_allclose(array(focal.slope(cells(a), 30.0, 20.0, tile=5), a.shape, "slope"), want, atol=1e-9)


@pytest.mark.parametrize("inner, outer", [(0, 3.0), (1.5, 4.2)])
def test_ring(spark, cells, inner, outer):
    a = (np.random.default_rng(8).random((25, 30)) > 0.99).astype(float)
    ref = np.argwhere(a > 0)
    grid = spark.createDataFrame([("g", 25, 30)], "grid_id string, height int, width int")
    got = {(r["row"], r["col"]) for r in focal.distance_ring(cells(a).where("value > 0"), outer, grid, inner).collect()}
    want = set()
    for i in range(25):
        for j in range(30):
            d = np.sqrt(((ref - [i, j]) ** 2).sum(axis=1)).min()
            if max(inner, 1e-9) < d <= outer:
                want.add((i, j))
    assert got == want
