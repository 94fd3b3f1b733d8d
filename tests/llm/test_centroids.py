import hashlib
import math

import numpy as np
import pytest

from deltacell.llm import centroids as C


def plain(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    centers = [list(v) for _, v in named[:k]]
    d = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((d(v, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    whole = sum(x[2] for x in got)
    return sorted(
        (i is None, i or 0, c, s, sum(x[2] for x in got if x[1] == c), whole, hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest())
        for i, c, s in got
    )


def found(df):
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in df.collect())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, block int, cluster string")


def test_same_as_plain_rounds(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 64))
    rows = [(int(i), (middles[i % 12] + rng.normal(size=64) * 0.4).tolist()) for i in range(700)]
    rows += [(9001, None), (9002, [1.0] * 63), (9003, [1.0] * 65), (9004, [None] + [1.0] * 63), (9005, [math.nan] + [1.0] * 63), (9006, [math.inf] + [0.0] * 63)]
    rows += [(None, [0.5] * 64), (3, rows[3][1]), (3, rows[3][1]), (4, [-0.25] * 64), (9007, [0.0] * 64), (9008, [1500.0] + [0.0] * 63)]
    df = vectors(spark, rows).repartition(3)
    assert found(C.cluster(df)) == plain(rows)


def test_bounds_save_scans(spark):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(8, 64)) * 3
    rows = [(int(i), (middles[i % 8] + rng.normal(size=64) * 0.3).tolist()) for i in range(1500)]
    run = C.Run(vectors(spark, rows), 8, "3:", 64, 1024, "vec_id", "embedding")
    for _ in range(6):
        run.assign()
        run.update()
    assert run.scanned[0] == 1500 and run.scanned[-1] < 300


def test_ties_few_and_none(spark):
    same = [(i, [0.5] * 64) for i in range(20)] + [(i, [1.5] * 64) for i in range(20, 40)]
    assert found(C.cluster(vectors(spark, same))) == plain(same)
    few = [(1, [0.1] * 64), (2, [0.2] * 64), (3, [0.3] * 64)]
    assert found(C.cluster(vectors(spark, few))) == plain(few)
    one = [(1, [0.1] * 64)]
    assert found(C.cluster(vectors(spark, one))) == plain(one)
    assert C.cluster(vectors(spark, [(1, None)])).collect() == []
    assert C.cluster(vectors(spark, one).where("false")).collect() == []


def test_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(size=64) * 20_000).tolist()) for i in range(60)]
    assert found(C.cluster(vectors(spark, rows))) == plain(rows)
    with pytest.raises(Exception, match="63 bits"):
        C.cluster(vectors(spark, [(1, [2.0e5] * 64)]))


def test_loosening_bounds_every_point_of_the_sphere():
    rng = np.random.default_rng(3)
    less = 0
    for _ in range(300):
        k, size = 5, int(rng.integers(2, 7))
        old = rng.normal(size=(k, size)) * 5
        new = old + rng.normal(size=(k, size)) * rng.choice([0.0, 0.3, 3.0], size=(k, 1))
        radius = rng.random(k) * rng.choice([0.0, 1.0, 8.0])
        got = C.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(k):
            direction = rng.normal(size=(400, size))
            points = old[i] + direction / np.linalg.norm(direction, axis=1)[:, None] * radius[i] * rng.random((400, 1)) ** 0.2
            for j in set(range(k)) - {i}:
                nearer = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                assert nearer.max() <= got[i, j] + 1e-9
                assert got[i, j] <= drift[j] * (1 + 1e-12)
                less += got[i, j] < 0.9 * drift[j]
    assert less > 300
