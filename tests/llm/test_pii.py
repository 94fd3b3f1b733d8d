import random
import re

import numpy as np

from deltacell.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_equals_the_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("01259.@+-() a%é\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute(text), text
    for value in ("4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "0001.2.3.255", "x@y.z@w.q", "a@b..c@d.e", "+1 (017) 555-7713"):
        assert pii.base_spans(value) == brute(value)


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + " " + "a.b" * 100_000) == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(pii.WIDTH, pii.N)), pii._ALLOWED + rng.normal(size=(pii.N, pii.N)))
    rows = [rng.integers(0, pii.WIDTH, (n, 3)) for n in (1, 3, 4)]
    for r, path in zip(rows, field.viterbi(rows), strict=True):
        emit = field.weights[r].sum(1)
        best = max(
            np.ndindex(*([pii.N] * len(r))),
            key=lambda p: pii._START[p[0]] + sum(emit[t, p[t]] for t in range(len(p))) + sum(field.moves[a, b] for a, b in zip(p, p[1:])),
        )
        assert tuple(path) == tuple(best)


def test_field_on_unseen_rows():
    field = pii.train(pii.labelled_table())
    hit = total = wrong = 0
    for text, spans in pii.labelled_table(copies=4, seed=99):
        base = pii.base_spans(text)
        got = set(base) | set(pii.added_spans([text], [base], field, {})[0])
        truth = set(spans)
        hit += len(truth & got)
        total += len(truth)
        wrong += len({s for s in got - truth - set(base) if not any(a < s[2] and s[1] < b for _, a, b in truth)})
    assert hit >= 0.9 * total and wrong <= 0.02 * total, (hit, total, wrong)


def test_table(spark):
    rows = [(1, "mail a.b@c.de or 10.1.2.3", 5, "x"), (2, None, None, "x"), (3, "", 0, "x"), (4, "x" * 200_000, 200_000, "x"),
            (None, "call (212) 555-0187 now", 23, "x"), (1, "mail a.b@c.de or 10.1.2.3", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string")
    out = {r["doc_id"]: r for r in pii.span_digest(docs).collect()}
    assert (out[1]["n_email"], out[1]["n_ip"], out[1]["spans"]) == (1, 1, "email:5:13,ip:17:25")
    assert out[1]["base_sha256"] == pii.digest_of(pii.base_spans(rows[0][1]))
    assert out[2]["base_sha256"] == out[3]["base_sha256"] == pii.digest_of([]) and out[2]["spans"] == ""
    assert out[None]["n_phone"] == 0 and out[None]["spans"] == "phone:5:19"
    done = {r["doc_id"]: r for r in pii.redact(docs.drop("spans")).collect()}
    assert done[1]["text"] == "mail <EMAIL> or <IP>" and done[1]["n_chars"] == 20 and done[2]["text"] is None
    assert done[4]["text"] == rows[3][1] and done[None]["text"] == "call <PHONE> now"
    assert pii.span_digest(docs.where("false")).collect() == []
