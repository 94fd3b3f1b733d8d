import numpy as np

from deltacell.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<float>, v string"


def brute(rows, query_ids, top):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and i is not None}
    out = {}
    for q in query_ids:
        if q in ok:
            scored = sorted(((-float(sum(a * b for a, b in zip(ok[q], v))), i) for i, v in ok.items() if i != q))
            out[q] = scored[:top]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[:, 0] *= 3
    x[700:900] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] + [1.0] * 23), (5060, [None] + [1.0] * 23), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    asked = df.where("vec_id % 20 = 0")
    out = nearest(df, asked, block=400).toPandas()
    truth = brute(rows, range(0, 6000, 20), 20)
    assert set(out["query_id"]) == set(truth)
    hit = 0
    for q, own in out.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own["vec_id"])
        assert [(-s, i) for s, i in zip(own["score"], own["vec_id"])] == sorted((-s, i) for s, i in zip(own["score"], own["vec_id"]))
        full = dict((i, -s) for s, i in brute(rows, [q], 5000)[q])
        assert all(abs(full[i] - s) < 1e-9 for i, s in zip(own["vec_id"], own["score"]))
        hit += len(set(own["vec_id"]) & {i for _, i in truth[q]})
    assert hit >= 0.9 * 20 * len(truth), hit / 20 / len(truth)


def test_few_rows_are_all_returned(spark):
    rows = [(i, [float(i + 1), 1.0], "x") for i in range(5)] + [(0, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = [tuple(r) for r in nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert out == [(0, 1, 4, 6.0), (0, 2, 3, 5.0), (0, 3, 2, 4.0), (0, 4, 1, 3.0)]
    assert nearest(df.where("false"), df.where("false")).collect() == []
