import math
from collections import Counter

from deltacell.llm import mixing


def shares(spark, values):
    total = sum(values)
    return spark.createDataFrame([(v / total,) for v in values], "p double")


def test_exponent_meets_entropy_and_repeats(spark):
    values = [1000, 300, 100, 20]
    p = [v / sum(values) for v in values]

    def weights(a):
        z = sum(x ** a for x in p)
        return [x ** a / z for x in p]

    a = mixing.exponent(shares(spark, values), 0.9, 100.0, 1.0)
    h = -sum(w * math.log(w) for w in weights(a))
    assert 0 < a < 1 and abs(h - 0.9 * math.log(4)) < 1e-5
    b = mixing.exponent(shares(spark, values), 0.9, 2.0, 1.0)
    assert b > a and abs(max(w / x for w, x in zip(weights(b), p, strict=True)) - 2.0) < 1e-4
    assert mixing.exponent(shares(spark, [5, 5]), 0.9, 4.0, 1.0) == 1.0
    assert mixing.exponent(shares(spark, values), 0.9, 4.0, 9.0) == 1.0


def test_draws_follow_the_budget(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 10 else "small") for i in range(2000)]
    rows += [(5000, None, "small"), (5001, "", "none"), (5002, "a b", None), (5002, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'z' as epoch", "1 as start")
    out = mixing.draws(docs, entropy=0.95, repeats=4.0, blocks=16).collect()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    got, sizes = Counter(), Counter()
    for r in out:
        got[r["source"]] += r["n_tokens"]
    for _, t, s in rows:
        sizes[s or ""] += len((t or "").split())
    a = mixing.exponent(shares(spark, [v for v in sizes.values() if v]), 0.95, 4.0, 1.0)
    z = sum((v / total) ** a for v in sizes.values() if v)
    for s, v in sizes.items():
        goal = (v / total) ** a / z * total if v else 0
        assert goal - 7.1 <= got[s] <= goal + 1e-3, (s, got[s], goal)
    draws = Counter((r["doc_id"], r["epoch"]) for r in out if r["doc_id"] != 5002)
    assert max(draws.values()) == 1 and "none" not in got
    mixed = mixing.mix(docs, entropy=0.95, blocks=16)
    assert mixed.columns == docs.columns and mixed.count() == len(out)


def test_empty(spark):
    assert mixing.draws(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
