import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from deltacell.llm import bpe as B


@pytest.fixture(scope="module")
def truth():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return B.Coder(B.public_ranks())


HOSTILE = [
    "", " ", "\n\n \t x", "I'll we've 'S don't", "a" * 700, "ab" * 400, " " * 900, "é🙂ß‍́", "\x1c\x1d\x1e\x1f a\x85b c d　e​f﻿f",
    "<|endoftext|>", "Ⅷ½٣二 x²", "\x00\x01\x7f", "שלום мир 你好 مرحبا हिन्दी", "𝔘𝔫𝔦 \U0001f468‍\U0001f469", "\r\n\r\n a  b   c ", "=" * 999, "1234567890" * 60,
]


def test_hostile_texts(own, truth):
    ids = own.encode(HOSTILE)
    assert [x.tolist() for x in ids] == [truth.encode_ordinary(t) for t in HOSTILE]
    assert own.decode(ids) == [t.encode() for t in HOSTILE]


def test_random_texts(own, truth, monkeypatch):
    rng = random.Random(6)
    letters = "abcdefgh  \n'st\tÄéß..!?09🙂中"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(500))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x2000, 0xD000)])) for _ in range(200)) for _ in range(100)]
    want = [truth.encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in own.encode(texts)] == want
    monkeypatch.setattr(B, "PIECE", 40)
    monkeypatch.setattr(B, "DECODED", 40)
    monkeypatch.setattr(B, "KEPT_IDS", 50)
    ids = own.encode(texts[::8])
    assert [x.tolist() for x in ids] == want[::8] and own.decode(ids) == [t.encode() for t in texts[::8]]


def test_heap_and_query_contract_alike(own, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abet hin") for _ in range(rng.randrange(2, 150))).replace(" ", "") or "a" for _ in range(400)]
    own._forget()
    by_query = own.encode_words(words)
    monkeypatch.setattr(B, "LONG", 0)
    own._forget()
    by_heap = own.encode_words(words)
    assert by_query[0].tolist() == by_heap[0].tolist() and by_query[1].tolist() == by_heap[1].tolist()


def test_tables(spark, truth):
    rows = [(i, t, "x") for i, t in enumerate(HOSTILE)]
    rows += [(3, HOSTILE[3], "x"), (3, HOSTILE[3], "x"), (None, "no id", "x"), (90, None, "x"), (91, "word é " * 300_000, "x"), (92, "z" * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digests(docs).collect())
    want = []
    for i, t, _ in rows:
        ids = np.array(truth.encode_ordinary(t or ""), "<u4")
        want.append(((i is None, i or 0), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert B.digests(docs.where("false")).collect() == []


def test_unknown_id_raises(own):
    with pytest.raises(ValueError, match="not in the vocabulary"):
        own.decode([np.array([5, 50_256], "<u4")])
