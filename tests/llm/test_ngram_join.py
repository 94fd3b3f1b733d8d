import random
import re

from deltacell.llm import ids, ngram_join
from deltacell.llm.ngram_join import jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=4):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    out, bases = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 or not bases:
            text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 40, 120]))]
            if rng.random() < 0.4:
                text += shared
            bases.append(text)
        else:
            text = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(vocabulary)
            bases.append(text)
        out.append((i, rng.choice([" ", "\n", "\t"]).join(text).upper() if rng.random() < 0.2 else " ".join(text)))
    return out


def test_matches_brute_force(spark):
    rows = corpus(3, 160) + [(900, None), (901, ""), (902, " \n "), (903, "é è"), (904, "é è"), (905, "É è")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, token int")
    for bucket, block in ((64, 256), (2, 8)):
        got = {tuple(r) for r in jaccard_components(df, bits=12, bucket=bucket, block=block).collect()}
        assert got == brute(rows)


def test_missing_ids_and_repeats(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text + " end"), (None, "alone")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_components(df, bits=12).collect()), key=str)
    assert got == sorted([(5, 27, 5), (5, 27, 5), (None, 27, 5), (7, 28, 5), (None, 1, None)], key=str)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string"), bits=12).collect() == []


def test_common_passages_do_not_tie_documents_when_the_sketch_is_blind(spark, monkeypatch):
    """64 cells for 90,000 shingles tell nothing, as the usual number of cells at some gigabytes of text."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"u{rng.randrange(10**7)}" for _ in range(600)) + " " + passage * (i < 60)) for i in range(150)]
    rows += [(1000 + i, t + " more") for i, t in rows[:5]]
    links, groups = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda x: links.append(x.distinct().count()) or groups(x))
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), bits=6, bucket=16).collect()}
    assert got == brute(rows)
    assert links[0] < 20


def test_many_ids_and_small_blocks(spark, monkeypatch):
    rows = corpus(6, 120)
    monkeypatch.setattr(ids, "FEW", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_components(df, bits=8, bucket=4, weight=150).collect()} == brute(rows)
