"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns give the base spans of each kind. The field labels pieces (runs of letters or digits,
single signs) by their shapes and those around them; it is trained from a small labelled table and
decoded by Viterbi over padded numpy batches. Only stretches around a digit or an ``@`` are decoded,
because each kind needs one. A decoded span is added if it passes the kind's arithmetic (digit
count, checksum, byte range) and touches no base span.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltacell.llm import words as W

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits does; from any later digit it would end the same way.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGNAL = re.compile(r"[0-9@]")
_PIECE = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start; leftmost and non-overlapping within a kind.

    Time is linear in the text, also for very long runs of one character.
    """
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            out.append(("email", begin, end))
        at = text.find("@", max(end, at + 1))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- the labelled table -------------------------------------------------------------------------

#: Lines whose marked parts are personal data and whose rest is not. Letters in braces are filled in:
#: w word, n name, d digit, i a byte, h host, t top-level domain, l card number.
LINES = (
    "{w} {w} [email {n} @ {h}.{t}] {w} {w}", "{w}: [email {n}.{n}@{h}.{t}], {w}", "{w} [email {n}{d}{d}@ {h}.{t}] {w}",
    "{w} {w} [email {n}@{h}.{h}.{t}]. {w} {w}", "{w} ([email {n}_{n}@{h}.{t}]) {w}", "[email {n} @{h}.{t}] {w} {w}",
    "{w} {w} [ip {i}.{i}.{i}.{i}] {w} {w}", "{w} [ip {i} . {i} . {i} . {i}] {w}", "{w}=[ip {i}.{i}.{i}.{i}]:{d}{d}{d}{d} {w}",
    "{w} {w} [ip {i}. {i}. {i}. {i}], {w}",
    "{w} {w} [card {l}] {w} {w}", "{w} [card {4l}] {w}", "{w}: [card {4.l}], {w}", "{w} {w} [card {4/l}]. {w}", "{w} [card {4_l}] {w}",
    "{w} {w} [phone ({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}] {w} {w}", "{w}: [phone {d}{d}{d}-{d}{d}{d}-{d}{d}{d}{d}], {w}",
    "{w} [phone +{d} ({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}] {w}", "tel [phone {d}{d}{d}.{d}{d}{d}.{d}{d}{d}{d}] {w}",
    "phone [phone {d}{d}{d} {d}{d}{d} {d}{d}{d}{d}] {w}", "{w} [phone 00{d}{d} {d}{d}{d} {d}{d}{d}{d}{d}{d}] {w}",
    "{w} {w} {d}.{d} {w} {w}", "{w}, {w} {d}.{d}.{d} {w}", "{w} {w} {d}{d}{d}{d}-{d}{d}-{d}{d} {w}", "{w} {d}{d}.{d}{d}.{d}{d}{d}{d} {w}",
    "{w} {w} {d}{d}:{d}{d}:{d}{d} {w} {w}", "{w} {d},{d}{d}{d},{d}{d}{d} {w}", "{w} {w} {d}{d}{d}{d} {w} {w}", "{w} #{d}{d}{d}{d}{d}{d} {w}",
    "{w} {w} ${d}{d}.{d}{d} {w}", "{w} ({d}{d}{d}{d}) {w}, {w}", "{w} {d} {w} {d}{d} {w} {d}{d}{d} {w}", "{w} = \"{x}{x}{x}{x}\" {w}",
    "{w} {d}{d}{d}-{d}{d}{d} {w}", "{w} @{n} {w} {w}", "{w} {w} {d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d} {w}", "{w} {d} {d}{d}{d} {d}{d}{d} {w}",
    "{w} {d}{d}% {w} {d}.{d}{d} {w}", "{w} {d}{d}-{d}{d} {w} {w}", "{w} {w} {d}/{d}/{d}{d}{d}{d} {w}", "{w} {d}.{d}.{d}.{d}.{d} {w}",
    "{w} {d}{d}{d}{d}{d}-{d}{d}{d}{d} {w}", "{w} {d}{d}{d} {d}{d}{d} {w} {w}", "{d}{d}{d} {d}{d}{d} {d}{d}{d}{d} {d}{d} {d}{d}{d} {d}",
)


def labelled_table(copies: int = 12, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: every line ``copies`` times with other fillings, as (text, spans)."""
    rng = np.random.default_rng(seed)

    def letters(least, most):
        return "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(least, most + 1)))

    def card():
        digits = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(digits + str(k) for k in range(10) if luhn(digits + str(k)))

    def fill(m):
        key = m[1]
        if key[-1] == "l":
            digits, sep = card(), {"4l": "  ", "4.l": ".", "4/l": "/", "4_l": "_"}.get(key, "")
            return sep.join(digits[i:i + 4] for i in range(0, 16, 4)) if sep else digits
        if key == "w":
            word = letters(2, 9)
            return rng.choice([word, word.title(), word.upper(), word], p=[0.7, 0.15, 0.05, 0.1])
        return {
            "n": lambda: letters(1, 8), "d": lambda: str(rng.integers(0, 10)), "i": lambda: str(rng.integers(0, 256)),
            "h": lambda: letters(3, 9) + rng.choice(["", str(rng.integers(1, 10))]),
            "t": lambda: rng.choice(["com", "org", "net", "edu", "de", "fr", "es", "io"]),
            "x": lambda: "".join(rng.choice(list("0123456789abcdef"), 8)),
        }[key]()

    out = []
    for line in LINES * copies:
        text, spans = "", []
        for k, part in enumerate(re.split(r"[\[\]]", re.sub(r"\{([^}]*)\}", fill, line))):
            if k % 2:
                kind, _, value = part.partition(" ")
                spans.append((kind, len(text), len(text) + len(value)))
                part = value
            text += part
        out.append((text, spans))
    return out


# ---- the field ----------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(LABELS)
WIDTH = 1 << 13
_ALLOWED = np.array([[0 if not b.startswith("I") or a[2:] == b[2:] and a != "O" else -1e4 for b in LABELS] for a in LABELS])
_START = np.array([0 if not b.startswith("I") else -1e4 for b in LABELS])
_TOP = frozenset("com org net edu gov info de fr es uk eu io".split())


def _shape(piece: str) -> int:
    if piece[0].isascii() and piece[0].isdigit():
        n = len(piece)
        kind = f"d{n}" if n < 13 else "d13-19" if n < 20 else "d20+"
        if n <= 3:
            kind += "b" if int(piece) <= 255 else ""
    elif piece[0].isalpha():
        low = piece.lower()
        kind = "top" if low in _TOP else low if low in ("tel", "phone", "fax", "call") else (
            "a" if piece == low else "A" if piece.isupper() else "Aa") + str(min(len(piece), 3))
    else:
        kind = piece
    return zlib.crc32(kind.encode())


def pieces(text: str, begin: int, end: int, cache: dict[str, int]):
    """Start, end and shape of every piece, and whether white space stands before it."""
    spans, shapes = [], []
    for m in _PIECE.finditer(text, begin, end):
        w = m[0]
        s = cache.get(w)
        if s is None:
            if len(cache) > 200_000:
                cache.clear()
            s = cache[w] = _shape(w)
        spans.append(m.span())
        shapes.append(s)
    a = np.array(spans, np.int64).reshape(-1, 2)
    gap = np.ones(len(a), np.int64)
    gap[1:] = a[1:, 0] > a[:-1, 1]
    return a, np.array(shapes, np.int64), gap


def feature_rows(shapes: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Hashed feature ids of each piece of one sequence: shapes at -2 to 2, pairs, and gaps."""
    n = len(shapes)
    s = np.zeros(n + 6, np.int64)
    g = np.ones(n + 6, np.int64)
    s[3:n + 3], g[3:n + 3] = shapes, gap

    def at(k):
        return s[3 + k:3 + k + n] * 2 + g[3 + k:3 + k + n]

    mixes = [at(0), at(-1), at(1), at(-2), at(2), at(-1) * 31 + at(0) * 7, at(0) * 31 + at(1) * 7, at(-1) * 37 + at(1) * 11,
             at(-2) * 31 + at(-1) * 17 + at(0) * 7, at(0) * 31 + at(1) * 17 + at(2) * 7, at(-3) * 13 + at(-1) * 5, at(1) * 13 + at(3) * 5]
    return np.stack([(m * 2654435761 + k * 40503) % 4294967291 % WIDTH for k, m in enumerate(mixes)], 1)


@dataclass
class Field:
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(r) for r in rows])
        out = np.zeros((len(rows), max(1, length.max(initial=1)), N))
        for k, r in enumerate(rows):
            out[k, :len(r)] = self.weights[r].sum(1)
        return out, length

    def viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of every sequence, all advanced together one piece at a time."""
        emit, length = self.scores(rows)
        n, steps, _ = emit.shape
        back = np.zeros((n, steps, N), np.int8)
        best = emit[:, 0] + _START
        last = best.copy()
        for t in range(1, steps):
            total = best[:, :, None] + self.moves[None]
            back[:, t] = total.argmax(1)
            best = total.max(1) + emit[:, t]
            last = np.where((length > t)[:, None], best, last)
        path = np.zeros((n, steps), np.int64)
        label = last.argmax(1)
        for t in range(steps - 1, -1, -1):
            label = np.where(t == length - 1, last.argmax(1), label)
            path[:, t] = label
            label = back[np.arange(n), t, label] if t else label
        return [p[:k] for p, k in zip(path, length, strict=True)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(table: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 60, rate: float = 0.15, ridge: float = 1e-4) -> Field:
    """Maximise the conditional likelihood by Adam over the whole table, with forward-backward in batches."""
    rows, gold, cache = [], [], {}
    for text, spans in table:
        a, shapes, gap = pieces(text, 0, len(text), cache)
        y = np.zeros(len(a), np.int64)
        for kind, begin, end in spans:
            inside = np.flatnonzero((a[:, 0] >= begin) & (a[:, 1] <= end))
            y[inside] = LABELS.index(f"I-{kind}")
            y[inside[:1]] = LABELS.index(f"B-{kind}")
        if len(a):
            rows.append(feature_rows(shapes, gap))
            gold.append(y)
    n, steps_t = len(rows), max(map(len, rows))
    length = np.array([len(r) for r in rows])
    live = np.arange(steps_t)[None] < length[:, None]
    flat = np.concatenate(rows)
    field = Field(np.zeros((WIDTH, N)), _ALLOWED.copy())
    free = _ALLOWED == 0
    want, y_pad = np.zeros((n, steps_t, N)), np.zeros((n, steps_t), np.int64)
    for k, y in enumerate(gold):
        want[k, np.arange(len(y)), y], y_pad[k, :len(y)] = 1, y
    want_moves = np.zeros((N, N))
    np.add.at(want_moves, (y_pad[:, :-1][live[:, 1:]], y_pad[:, 1:][live[:, 1:]]), 1)
    memory = [np.zeros_like(field.weights), np.zeros_like(field.weights), np.zeros((N, N)), np.zeros((N, N))]
    for step in range(1, steps + 1):
        emit = np.zeros((n, steps_t, N))
        emit[live] = field.weights[flat].sum(1)
        fore, backw = np.zeros_like(emit), np.zeros_like(emit)
        fore[:, 0] = emit[:, 0] + _START
        for t in range(1, steps_t):
            now = _logsum(fore[:, t - 1][:, :, None] + field.moves[None], 1) + emit[:, t]
            fore[:, t] = np.where(live[:, t, None], now, fore[:, t - 1])
        norm = _logsum(fore[:, -1], 1)
        for t in range(steps_t - 2, -1, -1):
            now = _logsum(field.moves[None] + (emit[:, t + 1] + backw[:, t + 1])[:, None, :], 2)
            backw[:, t] = np.where(live[:, t + 1, None], now, 0)
        belief = np.exp(fore + backw - norm[:, None, None])
        pairs = np.zeros((N, N))
        for t in range(1, steps_t):
            on = live[:, t]
            pairs += np.exp(fore[on, t - 1][:, :, None] + field.moves[None] + (emit[on, t] + backw[on, t])[:, None, :]
                            - norm[on, None, None]).sum(0)
        gap = (want - belief)[live]
        grad = np.stack([np.bincount(flat.ravel(), np.repeat(gap[:, k], flat.shape[1]), WIDTH) for k in range(N)], 1) / n
        grad -= ridge * field.weights
        for k, (g, x) in enumerate(((grad, field.weights), ((want_moves - pairs) / n * free, field.moves))):
            memory[2 * k] = 0.9 * memory[2 * k] + 0.1 * g
            memory[2 * k + 1] = 0.99 * memory[2 * k + 1] + 0.01 * g * g
            move = memory[2 * k] / (1 - 0.9 ** step) / (np.sqrt(memory[2 * k + 1] / (1 - 0.99 ** step)) + 1e-8)
            x += rate * (move if k == 0 else move * free)
    return field


# ---- spans --------------------------------------------------------------------------------------

MARGIN, CHUNK, STRIDE = 40, 256, 192


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within ``MARGIN`` characters of a digit or an ``@``, cut at white space where there is some."""
    out: list[list[int]] = []
    for m in _SIGNAL.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    for s in out:
        cut = text.find(" ", s[0], s[0] + MARGIN // 2) if s[0] else -1
        s[0] = cut + 1 if cut >= 0 else s[0]
        cut = text.rfind(" ", s[1] - MARGIN // 2, s[1]) if s[1] < len(text) else -1
        s[1] = cut if cut >= 0 else s[1]
    return [(a, b) for a, b in out]


def plausible(kind: str, value: str) -> bool:
    """The kind's arithmetic, for a span that the field proposes."""
    digits = "".join(_DIGIT.findall(value))
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", value))
    if kind == "ip":
        parts = re.split(r" ?\. ?", value)
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^\W\d_]", value)
    return 10 <= len(digits) <= 15 and len(re.findall(r"[0-9]+", value)) >= 3 and not re.search(r"[^0-9+(). -]", value)


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], field: Field, cache: dict[str, int]):
    """Spans that the field adds to each text."""
    jobs, rows = [], []
    for k, text in enumerate(texts):
        for begin, end in stretches(text):
            a, shapes, gap = pieces(text, begin, end, cache)
            if not len(a):
                continue
            feats = feature_rows(shapes, gap)
            for at in range(0, max(1, len(a) - (CHUNK - STRIDE)), STRIDE):
                last = at + CHUNK >= len(a)
                jobs.append((k, a[at:at + CHUNK], 0 if at == 0 else (CHUNK - STRIDE) // 2,
                             CHUNK if last else CHUNK - (CHUNK - STRIDE) // 2))
                rows.append(feats[at:at + CHUNK])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    for lo in range(0, len(order), 512):
        some = order[lo:lo + 512]
        for i, path in zip(some, field.viterbi([rows[i] for i in some]), strict=True):
            if not path.any():
                continue
            k, a, least, most = jobs[i]
            for b in np.flatnonzero(path % 2 == 1):
                if not least <= b < most:
                    continue
                e = b + 1
                while e < len(path) and path[e] == path[b] + 1:
                    e += 1
                kind, begin, end = KINDS[(path[b] - 1) // 2], int(a[b, 0]), int(a[e - 1, 1])
                glued = texts[k][begin - 1:begin].isalnum() or texts[k][end:end + 1].isalnum()
                if not glued and plausible(kind, texts[k][begin:end]) and all(end <= p or q <= begin for _, p, q in base[k] + out[k]):
                    out[k].append((kind, begin, end))
    return out


def ordered(spans):
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_spans(docs: DataFrame, labelled: list | None = None) -> DataFrame:
    """All columns of ``docs`` with ``spans``: kind, start, end (code points, end exclusive), base.

    Spans are ordered by kind (email, ip, card, phone), then start. A null or empty text has none;
    repeated rows repeat; an empty table gives an empty table. A column named ``spans`` is replaced.
    """
    field = train(labelled_table() if labelled is None else labelled)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        cache: dict[str, int] = {}
        for batch in W.slices(batches):
            texts = [t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]
            base = [base_spans(t) if _SIGNAL.search(t) else [] for t in texts]
            more = added_spans(texts, base, shared.value, cache)
            spans = [
                [{"kind": k, "start": a, "end": b, "base": own} for (k, a, b), own in
                 sorted([*((s, True) for s in x), *((s, False) for s in y)], key=lambda s: (KINDS.index(s[0][0]), s[0][1]))]
                for x, y in zip(base, more, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    W.text_batches(docs)
    kept = [f for f in docs.schema.fields if f.name != "spans"]
    at = [f.name for f in kept].index("text")
    given = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    schema = T.StructType([*kept, T.StructField("spans", T._parse_datatype_string(SPANS))])
    return given.mapInArrow(run, schema)


def redact(docs: DataFrame, labelled: list | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars``, if there, counts anew.

    Overlapping spans of different kinds are replaced together under the first one's kind. Rows
    without spans stay as they are, null texts too.
    """
    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        out = []
        for t, found in zip(text, spans, strict=True):
            if t is None or not len(found):
                out.append(t)
                continue
            parts, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [t[at:s["start"]], f"<{s['kind'].upper()}>"]
                at = max(at, s["end"])
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    found = find_spans(docs, labelled)
    done = F.when(F.size("spans") > 0, cut(F.col("text").cast("string"), "spans")).otherwise(F.col("text"))
    cleaned = found.withColumn("text", done)
    if "n_chars" in docs.columns:
        counted = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def span_digest(docs: DataFrame, labelled: list | None = None) -> DataFrame:
    """Per document: counts of base spans by kind, the digest of the base spans, and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = find_spans(docs.select("doc_id", "text"), labelled)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans)).encode()).hexdigest()
