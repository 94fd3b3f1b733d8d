import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from deltacell.llm import packing as K


def test_pieces_cover_every_id_once():
    rng = random.Random(4)
    for last in (True, False):
        for _ in range(60):
            made = []
            for doc in range(rng.randrange(60)):
                n = rng.choice([1, 2, 3, 7, 64, 65, 100, 128, 129, 300, 511, 512, 513, 1000, 1023])
                made.append(K.Piece(doc, 0, np.arange(n, dtype="<u4"), n))
            done, rest = K.pack_pieces(made, (1024, 512, 256, 128), last)
            seen = defaultdict(list)
            for window in done:
                size = sum(map(len, window))
                assert size <= 1024 and size & (size - 1) == 0 and all(len(p) for p in window)
            for p in [p for w in done for p in w] + rest:
                seen[p.doc].append((p.start, p.start + len(p)))
                assert p.ids.tolist() == list(range(p.start, p.start + len(p)))
            for p in made:
                spans = sorted(seen[p.doc])
                assert spans[0][0] == 0 and spans[-1][1] == len(p) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert sum(map(len, rest)) < 1024 and not (last and rest)


def test_step_groups_are_even():
    rng = random.Random(2)
    sequences = [[K.Piece(0, 0, np.zeros(n, "<u4"), n), K.Piece(0, 0, np.zeros(1024 - n, "<u4"), n)] for n in (rng.randrange(1, 1024) for _ in range(160))]
    groups = K.step_groups(sequences, 16 * 1024)
    cost, count = defaultdict(int), defaultdict(int)
    for s, g in zip(sequences, groups, strict=True):
        cost[g] += sum(len(p) ** 2 for p in s)
        count[g] += 1
    assert set(count.values()) == {16} and max(cost.values()) < 1.1 * min(cost.values())


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab é\n12'sT🙂  ") for _ in range(rng.randrange(3000))), "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "word " * 60_000, "x"), (103, "a <|endoftext|> b", "x"), (103, "a <|endoftext|> b", "x"), (None, "n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    out = K.pack(docs, pool=20_000).toPandas()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    out["doc_id"] = out["doc_id"].astype(object).where(out["doc_id"].notna(), None)
    for i, truth in want.items():
        own = out[out["doc_id"].isna()] if i is None else out[out["doc_id"] == i]
        got = defaultdict(list)
        for r in own.sort_values("start").itertuples():
            assert r.length == len(r.ids) // 4 and r.doc_tokens == len(truth[0])
            got[r.start].append(np.frombuffer(r.ids, "<u4").tolist())
        assert sum(len(x) for v in got.values() for x in v) == len(truth) * len(truth[0])
        for start, parts in got.items():
            assert all(truth[0][start:start + len(x)] == x for x in parts)
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
        total = int(s["length"].sum())
        assert total <= 1024 and total & (total - 1) == 0 and set(s["tier"]) == {total}
    crc = K.pieces(docs.where("doc_id = 103")).toPandas()
    assert set(crc["ids_crc32"]) <= {zlib.crc32(np.array(want[103][0][a:b], "<u4").tobytes()) for a in range(9) for b in range(a + 1, 10)}
    assert K.pieces(docs.where("false")).collect() == []
