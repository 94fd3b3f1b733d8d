import random
import zlib

import numpy as np
import pyarrow as pa

from deltacell.llm import toxicity as X
from deltacell.llm.words import buffers


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(1)
    lexicon = {"idiot": 2.0, "scum": 1.0, "worthless": 3.0, "vequ*": 4.0}
    auto = X.compile_lexicon(lexicon)
    words = ["idiot", "worthless", "scum", "vequation", "veq", "x"]
    for w in list(words):
        for _ in range(300):
            chars = list(w)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(chars) + 1)
                chars[k:k + rng.randrange(2)] = rng.choice(["", rng.choice("abcdeiostuvwqrhl")])
            words.append("".join(chars) or "a")
    raw, offsets = buffers(pa.array([" ".join(words)]))
    starts, ends, _ = X.word_spans(raw, offsets)
    index, state = X.match(auto, raw, starts, ends)
    got = dict(zip(index.tolist(), zip(auto.edits[state].tolist(), auto.weight[state].tolist(), strict=True), strict=True))
    for k, w in enumerate(words):
        want = [(0, -4.0)] if w.startswith("vequ") else []
        for term, weight in lexicon.items():
            d = levenshtein(w, term)
            if term[-1] != "*" and d <= X._edits(term):
                want.append((d, -weight))
        assert got.get(k) == ((min(want)[0], -min(want)[1]) if want else None), w


def labelled(n=400):
    rng = random.Random(2)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["idiot", "worthless", "moronic"])
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_scores(spark):
    rows, labels = labelled()
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "worda idiot idiott worthles wordb moronic", None), (1003, "a " * 300000, "s"),
             (None, "worda", "s"), (1, rows[1][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = X.toxicity(docs, marks).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    by = out.dropna(subset=["doc_id"]).set_index(out["doc_id"].dropna().astype(int))
    assert all(by["held_out"][i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(2, 400))
    assert [int(by["predicted"][i]) for i, _, _ in labels if i != 1] == [t for i, _, t in labels if i != 1]
    assert by["predicted"][1000] == by["predicted"][1001] == by["predicted"][1003] == 0 and by["predicted"][1002] == 1


def test_quotation_counts_apart():
    auto = X.compile_lexicon({"idiot": 2.0})
    x = X.features(auto, pa.array(['he said "you idiot" once', "you idiot", "you idiott", 'a "b" idiot']), 10)
    assert np.allclose(x[0][:4], [0, 0, np.log1p(2), 0]) and np.allclose(x[1][:4], [np.log1p(2), 0, 0, np.log1p(2)])
    assert x[2][1] > 0 == x[2][0] and x[3][0] > 0


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in X.toxicity(docs, none).collect()] == [0]
    assert X.toxicity(docs.where("false"), none).collect() == []


def test_learnt_words_keep_their_edits(spark):
    rows, labels = labelled()
    wrong = ["idoit", "idiit", "wrothless", "wortless", "mornic", "mroonic", "moroniic"]
    rows += [(1000 + k, f"worda wordb {w} wordc {w} wordd", "s") for k, w in enumerate(wrong)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = X.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    x = X.features(model.automaton, pa.array([t for i, t, _ in rows if i >= 1000]), model.window)
    assert (x[:, 1] > 0).all() and (x[:, 0] == 0).all()
    out = {r["doc_id"]: r["score"] for r in X.score(docs, model).collect()}
    assert min(out[1000 + k] for k in range(len(wrong))) > max(out[i] for i, _, bad in labels if not bad)


def test_stems_have_edits_and_swaps_are_one():
    auto = X.compile_lexicon({"stupi*": 2.0, "idiot": 1.0, "moro*": 3.0}, swaps=True)
    words = ["stupidity", "stpuidity", "stuidly", "stxxidly", "idoit", "diiot", "iidto", "moron", "mroon"]
    raw, offsets = buffers(pa.array([" ".join(words)]))
    starts, ends, _ = X.word_spans(raw, offsets)
    index, state = X.match(auto, raw, starts, ends)
    got = {words[i]: int(e) for i, e in zip(index.tolist(), auto.edits[state], strict=True)}
    assert got == {"stupidity": 0, "stpuidity": 1, "stuidly": 1, "idoit": 1, "diiot": 1, "moron": 0}
