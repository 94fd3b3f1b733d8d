import re

import numpy as np
import pytest

from deltacell.operators import evaluate, objects


def flood(a):
    lab, todo = {}, {tuple(p) for p in np.argwhere(a)}
    while todo:
        start = min(todo)
        todo.discard(start)
        group, front = [start], [start]
        while front:
            r, c = front.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    q = (r + dr, c + dc)
                    if q in todo:
                        todo.discard(q)
                        group.append(q)
                        front.append(q)
        for g in group:
            lab[g] = start[0] * (1 << 31) + start[1]
    return lab


def snake(n=30):
    """One object that winds through every tile, and crosses each border many times."""
    a = np.zeros((n, n), bool)
    a[::2] = True
    a[1::4, -1] = True
    a[3::4, 0] = True
    return a


@pytest.mark.parametrize("tile", [4, 7, 256])
@pytest.mark.parametrize("mask", [np.random.default_rng(1).random((40, 33)) > 0.62, snake()], ids=["noise", "snake"])
def test_components(cells, mask, tile):
    df = cells(mask.astype(float)).where("value > 0")
    got = {(r["row"], r["col"]): r["label"] for r in objects.components(df, tile).collect()}
    assert got == flood(mask)


def test_sizes_and_area(cells):
    a = np.zeros((20, 20))
    a[2:7, 2:7] = 1
    a[12:14, 12:14] = 1
    lab = objects.components(cells(a).where("value > 0"), 4)
    kept = objects.object_stats(objects.remove_small(lab, 10), 100.0).collect()
    assert len(kept) == 1 and kept[0]["n_px"] == 25 and kept[0]["area_ha"] == pytest.approx(0.25)
    assert objects.remove_small(lab, 1).count() == 29 and objects.remove_small(lab, 4).count() == 29


def wkt_area(text):
    total = 0.0
    for ring in re.findall(r"\(([^()]+)\)", text):
        p = np.array([[float(v) for v in q.split()] for q in ring.split(", ")])
        total += (p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2
    return abs(total)


def test_outlines_cover_objects(cells):
    a = np.random.default_rng(9).random((24, 24)) > 0.55
    a[5:12, 5:12] = True
    a[8, 8] = False
    lab = objects.components(cells(a.astype(float)).where("value > 0"), 8)
    sizes = {r["label"]: r["n_px"] for r in objects.object_stats(lab, 1.0).collect()}
    area = {}
    for r in objects.outlines(lab, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0]).collect():
        area[r["label"]] = area.get(r["label"], 0.0) + wkt_area(r["wkt"])
    assert area == pytest.approx(sizes)


def test_touching_corners_are_one_ring(cells):
    for a in ([[1, 0], [0, 1]], [[0, 1], [1, 0]]):
        lab = objects.components(cells(np.array(a, float)).where("value > 0"))
        out = objects.outlines(lab, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0]).collect()
        assert len(out) == 1 and out[0]["n_rings"] == 1 and wkt_area(out[0]["wkt"]) == 2.0


def test_object_metrics(cells):
    ref = np.zeros((10, 10))
    ref[1:3, 1:5] = 1
    ref[6:8, 6:8] = 1
    det = np.zeros((10, 10))
    det[1:3, 1:3] = 1
    det[9, 0] = 1
    lab = lambda m: objects.components(cells(m).where("value > 0"), 4)
    m = evaluate.object_metrics(lab(ref), lab(det)).first()
    assert (m["n_ref"], m["n_det"], m["pa"], m["ua"]) == (2, 2, 0.5, 0.5)


def _ring_set(wkt):
    """Rings as sets of directed sides, whatever corner they start from."""
    import re

    out = []
    for text in re.findall(r"\(([^()]+)\)", wkt):
        points = [tuple(float(v) for v in p.split()) for p in text.split(", ")]
        assert points[0] == points[-1]
        out.append(frozenset(zip(points, points[1:])))
    return sorted(out, key=sorted)


def test_ring_order_by_joins_equals_tracing(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(11)
    a = rng.random((40, 40)) < 0.55
    a[0:3, 0:3] = [[1, 0, 1], [0, 1, 0], [1, 0, 1]]
    spiral = np.zeros((41, 41), bool)
    for k in range(0, 20, 2):
        spiral[k, k:41 - k] = spiral[40 - k, k:41 - k] = spiral[k:41 - k, k] = spiral[k:41 - k, 40 - k] = True
        spiral[k + 1, k] = False
        spiral[k + 2, k + 1] = True
    parts = [pd.DataFrame({"grid_id": g, "row": np.nonzero(m)[0].astype("int32"), "col": np.nonzero(m)[1].astype("int32")}) for g, m in (("a", a), ("s", spiral))]
    labelled = objects.components(spark.createDataFrame(pd.concat(parts)), 16)
    gt = [500000.0, 10.0, 0.0, 5002500.0, 0.0, -10.0]
    traced = {(r.grid_id, r.label): (r.n_rings, _ring_set(r.wkt)) for r in objects.outlines(labelled, gt).collect()}
    joined = {(r.grid_id, r.label): (r.n_rings, _ring_set(r.wkt)) for r in objects.outlines(labelled, gt, task_corners=0).collect()}
    mixed = {(r.grid_id, r.label): (r.n_rings, _ring_set(r.wkt)) for r in objects.outlines(labelled, gt, task_corners=30).collect()}
    assert traced == joined == mixed and max(n for n, _ in traced.values()) > 5
    # A long ring is spread: no key of the joins or of the result holds more than one corner.
    points = objects.ring_points(labelled)
    assert points.groupBy("grid_id", "ring", "place").count().where("count > 1").isEmpty()
    assert points.groupBy("grid_id", "ring").count().agg({"count": "max"}).first()[0] > 60
