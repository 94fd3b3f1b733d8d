import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from deltacell.llm import quality as Q
from deltacell.llm.words import buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_counts():
    rng = random.Random(3)
    texts = ["", "\n\n", "a\na \na\n", None, "é" * 5000 + "\n" + "é" * 5000]
    for _ in range(400):
        texts.append("".join(rng.choice(["ab", "é", "c", " ", " ", "\n", "\t", "#", "|", "\x85", "　"]) for _ in range(rng.randrange(120))))
    raw, offsets = buffers(pa.array(texts))
    assert Q.text_counts(raw, offsets).tolist() == [brute(t) for t in texts]


def reference_model(texts):
    """Modified Kneser-Ney from its definition, over tuples of symbols."""
    counts = [None] * (Q.ORDER + 1)
    counts[Q.ORDER] = Counter()
    for t in texts:
        codes = [0] * (Q.ORDER - 1) + [int(Q._CLASS[b]) for b in t.encode() if b & 0xC0 != 0x80]
        counts[Q.ORDER].update(tuple(codes[i:i + Q.ORDER]) for i in range(len(codes) - Q.ORDER + 1))
    for k in range(Q.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = [None], [None]
    for k in range(1, Q.ORDER + 1):
        n = Counter(counts[k].values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        discounts.append([0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.1) if n[i] else 0.5 for i in (1, 2, 3)])
        by = defaultdict(list)
        for g, c in counts[k].items():
            by[g[:-1]].append(c)
        contexts.append(by)

    def p(g):
        if not g:
            return 1 / Q.SYMBOLS
        k = len(g)
        own = contexts[k].get(g[:-1])
        if not own:
            return p(g[1:])
        d = discounts[k]
        c = counts[k].get(g, 0)
        left = sum(d[min(x, 3)] for x in own) / sum(own)
        return max(c - d[min(c, 3)], 0) / sum(own) + left * p(g[1:])

    return p


def test_model_equals_its_definition(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the ", "cat ", "sat, ", "on ", "m4t ", "é "]) for _ in range(rng.randrange(40))) for _ in range(30)]
    docs = spark.createDataFrame([("en", t) for t in texts] + [("fr", "le chat"), ("", None)], "lang string, text string")
    model = Q.gather(Q.probabilities(Q.count_grams(docs)))["en"]
    p = reference_model(texts)
    values = [tuple(rng.randrange(Q.SYMBOLS) for _ in range(Q.ORDER)) for _ in range(200)]
    codes = [0] * 4 + [int(Q._CLASS[b]) for b in texts[0].encode() + texts[1].encode() if b & 0xC0 != 0x80]
    values += [tuple(codes[i:i + 5]) for i in range(len(codes) - 5)]
    packed = np.array([sum(s << (Q.BITS * (Q.ORDER - 1 - i)) for i, s in enumerate(g)) for g in values])
    got = Q.log_probability(model, packed)
    assert np.allclose(got, [math.log(p(g)) for g in values], atol=1e-5)
    context = values[-1][:-1]
    total = np.exp(Q.log_probability(model, np.array([sum(s << (5 * (4 - i)) for i, s in enumerate((*context, w))) for w in range(32)]))).sum()
    assert abs(total - 1) < 1e-5


def test_rules(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice(["an", "the", "or", "is", "er"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))), "en", 1) for i in range(200)]
    rows += [(1000, " ".join("".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(100)), "en", 1), (1001, "word " * 300, "en", 1),
             (1002, None, "en", 1), (1003, "", None, 1), (1004, "short text", "en", 1), (1005, rows[0][1], None, 1), (3, rows[3][1], "en", 1)]
    out = Q.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, log_ppl int")).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i, t, _, _ in rows:
        r = by[i]
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == brute(t)
        assert r["base_failed"] == (brute(t)[0] < 50 or 100 * brute(t)[4] > 50 * brute(t)[0])
    assert all(by[i]["kept"] for i in range(200)) and not any(by[i]["kept"] for i in range(1000, 1005))
    assert Q.rules(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_letters_beyond_ascii_are_told_apart(spark):
    rng = random.Random(9)
    texts = ["", "aé中😀z", "\x7f\x80߿ࠀ\uffff𐀀"] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x400, 0x460), rng.randrange(0x4E00, 0x9F00)]))
                                                             for _ in range(rng.randrange(30))) for _ in range(50)]
    raw, offsets = buffers(pa.array(texts))
    points, _ = Q.letters(raw)
    assert points.tolist() == [ord(c) for t in texts for c in t]
    kinds = lambda t: Q.classes(np.array([ord(c) for c in t])).tolist()
    lower = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    assert kinds(lower) == kinds(lower.upper()) and len(set(kinds(lower))) >= 31 and 0 not in kinds(lower)
    assert len(set(kinds("的一是不了人我在有他这中大来上"))) > 8
    # Shares of a class are exact, and with the classes' probabilities a letter's.
    docs = spark.createDataFrame([("ru", t) for t in texts], "lang string, text string")
    keys, value = Q.shares(Q.counts(docs))["ru"]
    got = dict(zip(keys.tolist(), value.tolist(), strict=True))
    seen = Counter(c for t in texts for c in t)
    total = Counter()
    for c, n in seen.items():
        total[kinds(c)[0]] += n
    for c, n in seen.items():
        if ord(c) >= 128:
            assert abs(got[ord(c)] - math.log(n / total[kinds(c)[0]])) < 1e-5


def test_words_of_another_script_are_judged_by_their_letters(spark):
    """Texts of the same shape, with letters of one alphabet in unlikely places."""
    rng = random.Random(2)
    stock = ["".join(rng.choice(["ка", "но", "сто", "ли", "пра"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(stock) for _ in range(rng.randrange(60, 200))), "ru") for i in range(150)]
    rows += [(1000, " ".join("".join(rng.choice("щъэфыж") for _ in range(rng.randrange(2, 7))) for _ in range(100)), "ru")]
    by = {r["doc_id"]: r for r in Q.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(by[i]["kept"] for i in range(150))
    assert not by[1000]["kept"] and by[1000]["perplexity"] > by[1000]["upper"]


def test_cases_digits_and_signs_have_their_own_shares(spark):
    texts = ["aA1 2,2.", "aab\t9?é", None]
    keys, value = Q.shares(Q.counts(spark.createDataFrame([("en", t) for t in texts], "lang string, text string")))["en"]
    got = dict(zip(map(chr, keys.tolist()), np.exp(value).tolist(), strict=True))
    assert got.keys() == set("aA1 2,.b\t9?é")
    for folded in ("aA", "129", " \t", ",.?"):
        seen = Counter(c for t in texts[:2] for c in t if c in folded)
        assert all(abs(got[c] - n / seen.total()) < 1e-5 for c, n in seen.items())
    # Texts of one shape and one row of classes differ in their perplexity.
    rng = random.Random(4)
    stock = ["".join(rng.choice(["ka", "no", "sto", "li"]) for _ in range(rng.randrange(1, 4))) + "," for _ in range(300)]
    rows = [(i, " ".join(rng.choice(stock) for _ in range(100)), "en") for i in range(150)]
    rows += [(1000, rows[0][1].replace(",", "?"), "en"), (1001, rows[0][1].upper(), "en")]
    by = {r["doc_id"]: r for r in Q.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(by[i]["kept"] for i in range(150)) and not by[1000]["kept"] and not by[1001]["kept"]
