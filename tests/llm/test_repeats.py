import random
from itertools import combinations

import numpy as np

from deltacell.llm import repeats as R


def test_bands_reach_their_recall():
    for s in (0.7, 0.8, 0.9):
        b, r = R.tuned_bands(s, 0.995)
        assert 1 - (1 - s ** r) ** b >= 0.995


def test_winnowing_keeps_the_smallest_of_every_window():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 24, 25, 100):
        x = rng.integers(0, 1000, n).astype(np.uint64)
        want = {j for i in range(max(1, n - 23)) if n for j in range(i, min(n, i + 24)) if x[j] == x[i:i + 24].min()}
        assert set(R.winnowed(x, 24).tolist()) == want


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def shingles(line, size=5):
    w = line.lower().split()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def corpus():
    rng = random.Random(8)
    passage = " ".join(words(rng, 51))
    rows = [(i, "\n".join(" ".join(words(rng, rng.choice([5, 19, 20, 40]))) for _ in range(4))) for i in range(60)]
    rows += [(100 + i, " ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 30))) for i in range(4)]
    base = words(rng, 60)
    for i in range(12):
        near = list(base)
        for _ in range(i % 3):
            near[rng.randrange(60)] = "changed"
        rows.append((200 + i, " ".join(words(rng, 10)) + "\n" + " ".join(near).upper() + "\n"))
    return rows, passage


def test_clusters_and_passages(spark):
    rows, passage = corpus()
    extra = [(300, None), (301, ""), (302, " \n\n"), (None, passage), (303, "same " * 200_000), (100, rows[60][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + extra], "doc_id long, text string, unit int")
    for block in (256, 4):
        out = R.repeats(df, block=block).collect()
        lines = {(i, t) for i, x in rows for t in x.split("\n") if len(t.split()) >= 20}
        root = {x: x for x in lines}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in combinations(sorted(lines), 2):
            p, q = shingles(a[1]), shingles(b[1])
            if 100 * len(p & q) >= 80 * len(p | q):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        group = {}
        for x in lines:
            group.setdefault(find(x), set()).add(x[0])
        want = {(i, min(g)) for r, g in group.items() if len(g) > 1 for i in g}
        assert {(r["doc_id"], r["keeper"]) for r in out if r["kind"] == "paragraph"} == want
        spans = {r["doc_id"]: r for r in out if r["kind"] == "passage"}
        for i in range(100, 104):
            r = spans[i]
            assert 30 <= r["first_word"] and r["first_word"] + r["n_words"] <= 81 and r["keeper"] == 100 and r["removed"] == (i > 100)
        assert not {r["doc_id"] for r in out} & ({*range(60)} | {300, 301, 302, 303, None})


def test_empty(spark):
    assert R.repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_kept_by_their_own_document_are_not_removed(spark):
    rng = random.Random(9)
    two = [f"u{rng.randrange(10**6)}" for _ in range(140)]
    rows = [(1, " ".join(two[:100] + words(rng, 20))), (2, " ".join(two)), (3, " ".join(words(rng, 20) + two[40:]))]
    out = R.repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'passage'").collect()
    gone = {(r["doc_id"], k) for r in out if r["removed"] for k in range(r["first_word"], r["first_word"] + r["n_words"])}
    left = {w for i, t in rows for k, w in enumerate(t.split()) if (i, k) not in gone}
    assert any(i == 2 for i, _ in gone) and any(i == 3 for i, _ in gone) and left >= {*two}


def test_passages_are_exact_to_the_word(spark):
    rng = random.Random(10)
    rows, want, fresh = [], set(), iter(range(10**6))
    for n in (23, *[24] * 6, *[30] * 6, 40, 51, 80, 300):
        passage = [f"p{next(fresh)}" for _ in range(n)]
        for _ in range(2):
            before = rng.randrange(40)
            rows.append((len(rows), " ".join([*(f"q{next(fresh)}" for _ in range(before)), *passage, *(f"q{next(fresh)}" for _ in range(30))])))
            want |= {(rows[-1][0], before, n)} if n >= 24 else set()
    out = R.repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'passage'").collect()
    assert {(r["doc_id"], r["first_word"], r["n_words"]) for r in out} == want and len(out) == len(want)
    short = spark.createDataFrame([(1, "one two three four five six\nother words"), (2, "x\none two three four five six")], "doc_id long, text string")
    assert {(r["doc_id"], r["kind"], r["first_word"], r["n_words"]) for r in R.repeats(short).collect()} == {(1, "paragraph", 0, 6), (2, "paragraph", 1, 6)}


def test_windows_of_seeds_that_are_alike_everywhere_are_runs(spark, monkeypatch):
    """A long passage is a few rows, not one row a word, and no text is shuffled; the join gives the same parts."""
    rng = random.Random(11)
    long = words(rng, 3000)
    rows = [(i, " ".join([*words(rng, 30), *long, *words(rng, 30)])) for i in range(5)]
    rows += [(10, " ".join(long[1000:1500] + words(rng, 20))), (11, " ".join(words(rng, 20) + long[1200:1900])), (10, " ".join(long[1000:1500] + ["x"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    written = []
    settle = R.settle
    monkeypatch.setattr(R, "settle", lambda d: written.append(settle(d)) or written[-1])
    got = sorted(map(str, R.repeats(df).collect()))
    (found,) = [t for t in written if "keeper" in t.columns and "first" in t.columns]
    assert found.count() < 2000 and sum(len(t.split()) for _, t in rows) > 15000
    assert got == sorted(map(str, R.repeats(df, few=0).collect())) and got
    for i, text in rows[:5]:
        held = {k for r in R.repeats(df).where(f"doc_id = {i} and kind = 'passage'").collect() for k in range(r["first_word"], r["first_word"] + r["n_words"])} if i < 2 else set()
        assert i >= 2 or held >= {*range(30, 3030)}
