import random

import corpus_pipeline as C
from test_ngram_join import brute, shingles
from test_toxicity import labelled


def corpus(spark, tmp_path):
    rows, labels = labelled(300)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows]
    copy = next(r for r in rows if r[0] % 5)
    words = copy[1].split()
    rows += [(900, copy[1], "en", "s0", copy[4]), (901, " ".join(words[:-1] + ["wordz"]), "en", "s1", copy[4]),
             (902, None, None, None, None), (903, "", "en", "s0", 0), (904, "write to ann@example.org now", "en", "s2", 28), (None, "no id", "en", "s0", 5),
             (904, "write to ann@example.org now", "en", "s2", 28)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = C.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i, *_ in rows if i is None or i >= 300 or i % 5}
    alone = C.drop_near_copies(spark, docs, str(tmp_path))
    roots = {i for i, _, root in brute([(r[0], r[1]) for r in rows]) if i == root}
    got = [r["doc_id"] for r in alone.collect()]
    assert sorted(x for x in got if x is not None) == sorted(roots) and got.count(None) == 1
    clean = {r["doc_id"]: r for r in C.redact(spark, docs, str(tmp_path)).collect()}
    assert clean[904]["text"] == "write to <EMAIL> now" and clean[904]["n_chars"] == 20
    mixed = C.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.select("doc_id").collect()} <= {r[0] for r in rows}


def test_run(spark, tmp_path):
    corpus(spark, tmp_path)
    out = C.run(spark, str(tmp_path)).toPandas()
    sizes = out.groupby("sequence_id")["length"].sum()
    assert len(out) and all(n & (n - 1) == 0 and n <= 1024 for n in sizes)


def test_near_copies_of_five_words_at_four_fifths(spark):
    rng = random.Random(4)
    rows = []
    for i, n in enumerate([48, 49, 50, 51, 52, 53, 60]):
        words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:20], "changed", *words[21:]]))]
    sets = {i: shingles(t, 5) for i, t in rows}
    gone = {b for b in sets for a in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert gone == {3, 5, 7, 9, 11, 13}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in C.drop_near_copies(spark, docs, "").collect()} == {*sets} - gone
