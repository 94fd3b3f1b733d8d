import random
import re
from collections import defaultdict
from itertools import permutations

from deltacell.llm import audit as A


def plain(docs, labels):
    """The figures by applying every order to every document."""
    texts = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""].append(i)
    rows, parts = [], set()
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fail = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(texts[t]) < i,
        }
        good, bad = (any(x[0] == i and i is not None and x[k] == 1 for x in labels) for k in (1, 2))
        rows.append((lang or "", fail, good, bad))
        parts.add(lang or "")
    out, total = {}, defaultdict(int)
    for p in parts:
        for order in permutations("ABCDE"):
            here, name = [r for r in rows if r[0] == p], "".join(order)
            gone = [False] * len(here)
            for k, f in enumerate(order):
                hit = [r[1][f] for r in here]
                now = [h and not g for h, g in zip(hit, gone)]
                out[p, name, k + 1] = [
                    sum(not g and not h for h, g in zip(hit, gone)), sum(now), sum(h and g for h, g in zip(hit, gone)),
                    sum(h and sum(r[1].values()) == 1 for h, r in zip(hit, here)),
                    sum(n and r[2] for n, r in zip(now, here)), sum(n and r[3] for n, r in zip(now, here)),
                ]
                total[p, f] += sum(now)
                gone = [g or h for g, h in zip(gone, hit)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}
    return got


def made(seed=3, n=220):
    rng = random.Random(seed)
    pool = []
    for _ in range(40):
        words = [rng.choice(["ab", "Cd", "é", "EF", "#", "x$", *map(str, range(300))]) for _ in range(rng.choice([0, 3, 199, 200, 201, 420]))]
        pool.append(rng.choice([" ", "\n", "\t ", " "]).join(words))
    docs = [(i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(n)]
    docs += [(n + 1, None, "fr"), (n + 2, "", "fr"), (None, pool[0], "en"), (None, None, None), (5, docs[5][1], "en"), (5, docs[5][1], "en")]
    docs += [(n + 3, "word " * 400_000, "en"), (n + 4, "word " * 400_000, "de"), (6, "another text", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, n, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return docs, labels


def test_every_order(spark):
    docs, labels = made()
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, hash int, page string").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = found(A.audit(d, lab))
    assert got == plain(docs, labels) and len(got) == 600 * len({r[2] or "" for r in docs})


def test_joined_sketch_gives_the_same(spark, monkeypatch):
    docs, labels = made(8, 90)
    monkeypatch.setattr(A, "PAGES", 0)
    monkeypatch.setattr(A, "FEW", 0)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(A.audit(d, lab)) == plain(docs, labels)


def test_sketch_clears_only_unique_texts(spark):
    texts = [f"text {i}" for i in range(3000)] + [f"text {i}" for i in range(0, 3000, 10)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = A.flags(docs).collect()
    twice = {t for t in texts if texts.count(t) > 1}
    assert all(r.possible for r in rows if texts[r.doc_id] in twice)
    assert sum(r.possible for r in rows if texts[r.doc_id] not in twice) < 150
    crowded = A.flags(docs, cells_a_row=1).select("doc_id", "fails").collect()
    assert sorted(map(tuple, crowded)) == sorted((r.doc_id, r.fails) for r in rows)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(d, lab).collect() == []
    one = spark.createDataFrame([(1, "a", "en")], d.schema)
    assert found(A.audit(one, lab)) == plain([(1, "a", "en")], [])
