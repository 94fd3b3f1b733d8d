import numpy as np
import pytest
from pyspark.sql import functions as F

from deltacell.operators import evaluate as E
from deltacell.operators import order
from deltacell.operators.joins import attach, salted_join


@pytest.fixture
def skewed(spark):
    """One key with most of the rows, ties, a heavy tail, a tiny key, and NULLs."""
    rng = np.random.default_rng(0)
    hot = np.round(rng.standard_cauchy(6000), 2)
    rows = [("hot", float(v)) for v in hot] + [("small", 1.0), ("small", 2.0), ("hot", None), ("one", 5.0)]
    return spark.createDataFrame(rows, "k string, v double"), hot


@pytest.mark.parametrize("task_rows, octave", [(10, 1), (10, 32), (1_000_000, 32)])
def test_quantiles(skewed, task_rows, octave):
    df, hot = skewed
    probs = {"lo": 0.0, "q1": 0.05, "med": 0.5, "q3": 0.951, "hi": 1.0}
    out = {r["k"]: r for r in order.quantiles(df, ["k"], "v", probs, task_rows=task_rows, octave=octave, fan=4).collect()}
    for name, p in probs.items():
        assert out["hot"][name] == pytest.approx(np.quantile(hot, p), abs=1e-9)
        assert out["small"][name] == pytest.approx(np.quantile([1.0, 2.0], p))
    assert out["hot"]["n"] == 6000 and out["one"]["med"] == 5.0


def test_quantiles_of_any_size(spark):
    """Tiny and huge numbers, both signs, zeros, infinities, NaN as the largest, NULL keys, and a far, narrow range."""
    inf, nan = float("inf"), float("nan")
    wide = [-inf, -1e308, -3.0, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 2.5, 1.7e308, inf]
    far = [1e9 + i / 1024 for i in range(500)]
    rows = [("wide", v) for v in wide] + [("far", v) for v in far] + [("nan", 1.0), ("nan", nan), (None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    steps = {f"p{i}": i / 10 for i in range(11)}
    out = {r["k"]: r for r in order.quantiles(df, ["k"], "v", steps, task_rows=7, fan=8).collect()}
    assert [out["wide"][f"p{i}"] for i in range(11)] == wide
    assert [out["far"][f"p{i}"] for i in range(11)] == pytest.approx(np.quantile(far, np.linspace(0, 1, 11)), rel=1e-15)
    assert out["nan"]["p0"] == 1.0 and np.isnan(out["nan"]["p10"])
    assert order.quantiles(df.where("v > 5 and v < 5"), ["k"], "v", steps).count() == 0


def test_classes_never_fall(spark):
    rng = np.random.default_rng(4)
    bits = rng.integers(-(2**63), 2**63 - 1, 20_000, dtype=np.int64)
    v = np.sort(bits.view(np.float64)[np.isfinite(bits.view(np.float64))])
    near = np.sort(np.concatenate([np.nextafter(2.0 ** (np.arange(-320, 320) / 32), 0), 2.0 ** (np.arange(-320, 320) / 32)]))
    for values in (v, near, -near[::-1]):
        df = spark.createDataFrame([(float(a),) for a in values], "v double")
        got = [r[0] for r in df.orderBy("v").select(order._class(F.col("v"), 32)).collect()]
        assert all(a <= b for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("task_rows", [50, 1_000_000])
def test_running_sums(skewed, task_rows):
    df, hot = skewed
    d = df.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("c"))
    out = order.running(d, ["k"], "v", ["c"], task_rows).where("k = 'hot'").collect()
    values = np.sort(hot)
    assert len(out) == len(np.unique(hot))
    for r in out:
        assert r["c_before"] == np.searchsorted(values, r["v"]) and r["c_all"] == 6000


def test_running_sums_of_null_keys(spark):
    """A NULL key that spans ranges gets the totals of earlier ranges like any other."""
    d = spark.createDataFrame([(None, float(i), 1) for i in range(200)] + [("a", 1.0, 3)], "k string, v double, c int")
    out = order.running(d, ["k"], "v", ["c"], 20).collect()
    assert all((r["c_before"], r["c_all"]) == ((r["v"], 200) if r["k"] is None else (0, 3)) for r in out)


def rank_auc(pos, neg):
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


@pytest.fixture
def samples(spark):
    rng = np.random.default_rng(5)
    pos, neg = np.round(rng.normal(0.4, 1, 300), 1), np.round(rng.normal(0, 1, 900), 1)
    rows = [("a", 0, i, float(v), True) for i, v in enumerate(pos)] + [("a", 1, i, float(v), False) for i, v in enumerate(neg)]
    return spark.createDataFrame(rows, "grid_id string, row int, col int, score double, positive boolean"), pos, neg


@pytest.mark.parametrize("task_rows", [20, None])
def test_auc_and_youden(samples, task_rows):
    df, pos, neg = samples
    curve = E.score_curve(df, ["grid_id"], task_rows)
    assert E.rank_auc(curve, ["grid_id"]).first()["auc"] == pytest.approx(rank_auc(pos, neg))
    grid = np.unique(np.percentile(np.concatenate([pos, neg]), np.linspace(0.1, 99.9, 400)))
    j = np.array([(pos >= t).mean() - (neg >= t).mean() for t in grid])
    y = E.youden_quantile(curve, ["grid_id"]).first()
    assert y["threshold"] == pytest.approx(grid[j.argmax()]) and y["tpr"] - y["fpr"] == pytest.approx(j.max())
    values = np.unique(np.concatenate([pos, neg]))
    k = np.array([(pos <= t).mean() - (neg <= t).mean() for t in values])
    assert E.youden_le(curve, ["grid_id"]).first()["threshold"] == pytest.approx(values[k.argmax()])


def test_reference_evaluation(samples, spark):
    df, pos, neg = samples
    r = E.reference_evaluation(df, ["grid_id"]).first()
    t = np.quantile(neg, 0.95)
    assert r["threshold"] == pytest.approx(t) and r["tpr"] == pytest.approx((pos > t).mean()) and r["fpr"] == pytest.approx((neg > t).mean())
    tied = spark.createDataFrame([("a", 0, i, 0.3, i < 4) for i in range(8)], df.schema)
    e = E.reference_evaluation(tied, ["grid_id"]).first()
    assert e["auc"] == 0.5 and e["tpr"] == 0.0
    with pytest.raises(ValueError):
        E.reference_evaluation(tied.unionByName(tied.withColumn("positive", ~F.col("positive"))), ["grid_id"])
    with pytest.raises(Exception, match="at least two"):
        E.reference_evaluation(tied.where("col > 2"), ["grid_id"]).collect()


def test_sensitivity_keeps_empty_variant(samples):
    df, pos, neg = samples
    out = {r["variant"]: r for r in E.background_sensitivity(df, ["grid_id"], {"all": F.lit(True), "none": F.lit(False)}).collect()}
    assert out["all"]["auc"] == pytest.approx(rank_auc(pos, neg))
    assert out["none"]["auc"] is None and out["none"]["n_bg"] == 0 and out["none"]["n_ref"] == 300


@pytest.mark.parametrize("task_rows", [3, 1_000_000])
def test_spearman(spark, task_rows):
    x, y = [1.0, 2.0, 2.0, 4.0, 5.0], [3.0, 1.0, 2.0, 5.0, 5.0]
    df = spark.createDataFrame([("a", p, q) for p, q in zip(x, y)], "k string, x double, y double")
    rank = lambda v: np.array([(np.array(v) < a).sum() + ((np.array(v) == a).sum() + 1) / 2 for a in v])
    assert order.spearman(df, ["k"], "x", "y", task_rows).first()["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    rng = np.random.default_rng(7)
    x = [1e300] + [float(a) for a in rng.integers(0, 40, 400)]
    y = [a % 7 + float(b) for a, b in zip(x, rng.integers(0, 9, 401))]
    many = spark.createDataFrame([(None, p, q) for p, q in zip(x, y)] + [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("flat", None, 1.0)], df.schema)
    out = {r["k"]: r for r in order.spearman(many.where("k is null or k = 'flat'").fillna("big", ["k"]), ["k"], "x", "y", task_rows).collect()}
    assert out["big"]["n"] == 401 and out["big"]["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert out["flat"]["n"] == 2 and out["flat"]["rho"] is None


def test_attach_both_ways(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2)], "k string, i int")
    look = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    small, large = attach(df, look, ["k"]), attach(df, look, ["k"], max_bytes=0)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    assert salted_join(df, look, ["k"], "inner").count() == 51
