"""Quality rules: word and line counts, and bands on the perplexity of a Kneser-Ney model.

The model is over characters in two steps. Letters (case folded), digits, white space and signs fold
into 32 classes, over which letters beyond ASCII are dealt by their code points, and a gram of five
classes is a number below 2^25. Then each character has its share of its class, so two cases, digits and
signs are told apart as well. That bounds the model of a language by its alphabet, so it may be broadcast whatever the corpus holds. Grams and
letters are counted over all texts in Spark; continuation counts, the three discounts of modified Kneser-Ney smoothing and interpolated
probabilities are joins and aggregates over grams. A task looks grams up in sorted arrays.

Each language has its own band around its median log perplexity, in units of the median absolute
deviation. Texts above it are unlike their language, those below repeat too much.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell.llm import words as W
from deltacell.session import settle

ORDER, BITS, SYMBOLS = 5, 5, 32
_CLASS = np.full(256, 29, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 27
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[[33, 34, 39, 44, 46, 58, 59, 63]] = 28
_CLASS[128:192] = 31
_CLASS[192:] = 30
_MARK = ord("é")
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#*$%&|<>"]] = True


def letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point of every character, and the byte where it begins."""
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    out = raw[starts].astype(np.int32)
    far = np.flatnonzero(out >= 0xC0)
    first = out[far]
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | raw[starts[far[more]] + k] & 0x3F
    out[far] = point
    return out, starts


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each character. Letters beyond ASCII count on from é by code point and block, so neighbours in an
    alphabet differ and two cases agree; none has the class of white space."""
    out = _CLASS[np.minimum(points, 127)].astype(np.int32)
    far = np.flatnonzero(points >= 128)
    dealt = (_CLASS[0xC3] + points[far] - _MARK + 5 * (points[far] >> 8)) % SYMBOLS
    out[far] = np.where(dealt == 0, SYMBOLS - 1, dealt)
    return out


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram and code point at every character of each text, and where each text's begin."""
    points, starts = letters(raw)
    at = np.searchsorted(starts, offsets)
    codes, n = classes(points), len(offsets) - 1
    padded = np.zeros(len(codes) + (ORDER - 1) * n, np.int32)
    place = np.arange(len(codes)) + (ORDER - 1) * (np.repeat(np.arange(n), np.diff(at)) + 1)
    padded[place] = codes
    out = np.zeros(len(codes), np.int32)
    for k in range(ORDER):
        out = (out << BITS) | padded[place - (ORDER - 1) + k]
    return out, points, at


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, c) over all texts, with -1 - code point as the gram of a character; tasks sum before the shuffle."""
    def run(batches):
        held: dict[str, list] = {}

        def summed(parts):
            keys = np.concatenate([k for k, _ in parts])
            values, inverse = np.unique(keys, return_inverse=True)
            return values, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(values)).astype(np.int64)

        for batch in W.slices(batches):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                raw, offsets = W.buffers(batch.column(1).filter(pa.array(langs == lang)))
                for a, b in W.runs(offsets):
                    values, own, _ = grams(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    held.setdefault(lang, []).append(np.unique(values, return_counts=True))
                    near = np.bincount(own[own < 128], minlength=128)
                    far, c = np.unique(own[own >= 128], return_counts=True)
                    held[lang].append((-1 - np.concatenate([np.flatnonzero(near), far]).astype(np.int32), np.concatenate([near[near > 0], c])))
                    if len(held[lang]) >= 32:
                        held[lang] = [summed(held[lang])]
        for lang, parts in held.items():
            values, c = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values, pa.int32()), pa.array(c, pa.int64())], ["lang", "gram", "c"])

    return docs.mapInArrow(run, "lang string, gram int, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, c) over all texts."""
    return counts(docs).where("gram >= 0")


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, k, gram, logp, gamma): for grams the interpolated log probability, for contexts (logp null) the weight of lower orders."""
    levels = {ORDER: settle(counts)}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << (BITS * k)) - 1).alias("gram")
        levels[k] = settle(levels[k + 1].groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("c")))
    out, lower = None, None
    for k in range(1, ORDER + 1):
        ones = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        n = levels[k].groupBy("lang").agg(*ones)
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

        def discount(i, y=y):
            now, more = F.col(f"n{i}"), F.col(f"n{i + 1}")
            return F.when(now > 0, F.least(F.greatest(i - (i + 1) * y * more / now, F.lit(0.1)), F.lit(i - 0.1))).otherwise(F.lit(0.5))

        d = n.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        rows = levels[k].join(F.broadcast(d), "lang").withColumn("ctx", F.shiftright("gram", BITS))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("d", cut)
        contexts = settle(rows.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")))
        rows = rows.join(contexts, ["lang", "ctx"]).withColumn("own", (F.col("c") - F.col("d")) / F.col("total"))
        if lower is None:
            level = rows.withColumn("p", F.col("own") + F.col("gamma") / SYMBOLS)
        else:
            rows = rows.withColumn("rest", F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1))
            below = lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("q"))
            level = rows.join(below, ["lang", "rest"]).withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        lower = settle(level.select("lang", "gram", "p"))
        null = F.lit(None).cast("double")
        part = lower.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp"), null.alias("gamma")).union(
            contexts.select("lang", F.lit(k), "ctx", null, F.log("gamma")))
        out = part if out is None else out.union(part)
    return out


@dataclass
class Level:
    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    gamma: np.ndarray


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.full(len(wanted), default)
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], default)


def log_probability(model: list[Level], wanted: np.ndarray) -> np.ndarray:
    """Log probability of each gram's last symbol after the others."""
    out = np.full(len(wanted), -math.log(SYMBOLS))
    for k, level in enumerate(model, 1):
        gram = wanted & ((1 << (BITS * k)) - 1)
        hit, value = _lookup(level.keys, level.logp, gram, 0.0)
        _, gamma = _lookup(level.contexts, level.gamma, gram >> BITS, 0.0)
        out = np.where(hit, value, out + gamma)
    return out


def gather(table: DataFrame) -> dict[str, list[Level]]:
    """The model as sorted arrays by language. Tasks sort and pack them, so the driver holds no rows."""
    def packed(t: pa.Table) -> pa.Table:
        row = {"lang": t.column("lang")[:1], "k": t.column("k")[:1]}
        gram = t.column("gram").to_numpy()
        for keys, name in (("keys", "logp"), ("contexts", "gamma")):
            value = t.column(name).to_numpy()
            here = np.flatnonzero(~np.isnan(value))
            order = here[np.argsort(gram[here])]
            row[keys] = pa.array([gram[order].astype("<i4").tobytes()], pa.binary())
            row[name] = pa.array([value[order].astype("<f4").tobytes()], pa.binary())
        return pa.table(row)

    schema = "lang string, k int, keys binary, logp binary, contexts binary, gamma binary"
    out: dict[str, list[Level]] = {}
    for r in table.groupBy("lang", "k").applyInArrow(packed, schema).orderBy("lang", "k").toLocalIterator():
        arrays = [np.frombuffer(r[c], t) for c, t in (("keys", "<i4"), ("logp", "<f4"), ("contexts", "<i4"), ("gamma", "<f4"))]
        out.setdefault(r["lang"], []).append(Level(*arrays))
    return out


def shares(table: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Code points of each language in ascending order, with the log of their share of their class; ``table`` as :func:`counts` gives it."""
    def packed(t: pa.Table) -> pa.Table:
        item, c = -1 - t.column("gram").to_numpy(), t.column("c").to_numpy().astype(float)
        order = np.argsort(item)
        item, c = item[order], c[order]
        kind = classes(item)
        value = np.log(c / np.bincount(kind, c, SYMBOLS)[kind])
        return pa.table({"lang": t.column("lang")[:1], "items": pa.array([item.astype("<i4").tobytes()], pa.binary()),
                         "value": pa.array([value.astype("<f4").tobytes()], pa.binary())})

    rows = table.where("gram < 0").groupBy("lang").applyInArrow(packed, "lang string, items binary, value binary").toLocalIterator()
    return {r["lang"]: (np.frombuffer(r["items"], "<i4"), np.frombuffer(r["value"], "<f4")) for r in rows}


def text_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)
    starts, ends, first = W.word_spans(raw, offsets)
    out[:, 0] = np.diff(first)
    for k, flag in ((1, ((raw & 0xC0) != 0x80) & ~W._SPACE[raw]), (2, _SIGN[raw])):
        total = np.concatenate([[0], np.cumsum(flag)])
        out[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    hashes = W.span_hashes(raw, starts, ends)
    breaks = np.flatnonzero(raw == 10)
    heads = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    heads = heads[heads < len(raw)]
    tails = np.minimum(np.concatenate([heads[1:], [len(raw)]]), len(raw))
    tails = tails - ((tails > heads) & (raw[tails - 1] == 10)) if len(heads) else tails
    worded = np.searchsorted(starts, tails) > np.searchsorted(starts, heads)
    heads, tails = heads[worded], tails[worded]
    lines = W.span_hashes(raw, heads, tails) if len(heads) else np.zeros(0, np.uint64)
    line_of = np.searchsorted(heads, offsets)
    for i in range(n):
        own = lines[line_of[i]:line_of[i + 1]]
        if len(own) > 1:
            out[i, 3] = len(own) - len(np.unique(own))
        w = W.window_hashes(hashes[first[i]:first[i + 1]], 3)
        if len(w) > 1:
            _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
            again = counts[inverse] > 1
            if again.any():
                covered = np.zeros(len(w) + 2, bool)
                for k in range(3):
                    covered[k:k + len(w)] |= again
                out[i, 4] = covered.sum()
    return out


def measures(docs: DataFrame, model: dict[str, list[Level]], share: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ppl); no symbol, no log_ppl."""
    shared = docs.sparkSession.sparkContext.broadcast((model, share))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        model, share = shared.value
        for batch in W.slices(batches):
            langs = batch.column(1).to_pylist()
            raw, offsets = W.buffers(batch.column(2))
            table, loss = np.zeros((len(langs), 5), np.int64), np.full(len(langs), np.nan)
            by = np.array(langs, dtype=object)
            for a, b in W.runs(offsets):
                part, offs = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                table[a:b] = text_counts(part, offs)
                seen, which, at = grams(part, offs)
                for lang in set(langs[a:b]):
                    mine = np.flatnonzero(by[a:b] == lang)
                    own = np.concatenate([seen[at[i]:at[i + 1]] for i in mine])
                    values, inverse = np.unique(own, return_inverse=True)
                    each = log_probability(model[lang], values)[inverse] if len(own) else np.zeros(0)
                    if len(own):
                        each = each + _lookup(*share[lang], np.concatenate([which[at[i]:at[i + 1]] for i in mine]), 0.0)[1]
                    sums = np.concatenate([[0.0], np.cumsum(each)])
                    size = at[mine + 1] - at[mine]
                    ends = np.cumsum(size)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        loss[a + mine] = -(sums[ends] - sums[ends - size]) / size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(table[:, k]) for k in range(5)), pa.array(loss, from_pandas=True)],
                ["doc_id", "lang", *names, "log_ppl"])

    return docs.select("doc_id", "lang", "text").mapInArrow(
        run, f"doc_id long, lang string, {', '.join(f'{x} long' for x in names)}, log_ppl double")


def rules(docs: DataFrame, width: float = 8.0, least: float = 0.1) -> DataFrame:
    """Per document the counts, perplexity, its language's band, base_failed and kept.

    ``docs`` needs doc_id, text and lang; other columns are ignored. Base: fewer than 50 words, or
    more than half of the words in three-word windows that occur again. A document is kept if it
    passes the base and its log perplexity is within ``width`` median absolute deviations (at least
    ``least``) of its language's median over documents that pass the base. A null language is one of
    its own. Null and empty texts have no words and fail. Repeated rows repeat; an empty table gives
    an empty table.
    """
    W.text_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    counted = settle(counts(docs.select("lang", "text")))
    model = gather(probabilities(counted.where("gram >= 0")))
    share = shares(counted)
    known = [*model]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = settle(measures(docs.where(F.col("lang").isin(known)), model, share).withColumn("base_failed", failed)) if known else None
    if rows is None:
        blank = [F.lit(0).cast("long").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        null = F.lit(None).cast("double")
        return docs.select("doc_id", *blank, F.lit(True).alias("base_failed"), null.alias("perplexity"), null.alias("lower"),
                           null.alias("upper"), F.lit(False).alias("kept"))
    # Values are rounded, so an exact median holds a bounded number of distinct ones.
    passed = rows.where("not base_failed").withColumn("v", F.round("log_ppl", 3))
    middle = passed.groupBy("lang").agg(F.percentile("v", 0.5).alias("m"))
    spread = passed.join(F.broadcast(middle), "lang").groupBy("lang").agg(
        F.first("m").alias("m"), F.percentile(F.round(F.abs(F.col("v") - F.col("m")), 3), 0.5).alias("mad"))
    bands = settle(spread.select("lang", "m", F.greatest(F.lit(width) * F.col("mad"), F.lit(least)).alias("w")))
    out = rows.join(F.broadcast(bands), "lang", "left")
    inside = F.coalesce(F.abs(F.col("log_ppl") - F.col("m")) <= F.col("w"), F.lit(False))
    rest = docs.where(~F.col("lang").isin(known))
    scored = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.exp("log_ppl").alias("perplexity"),
        F.exp(F.col("m") - F.col("w")).alias("lower"), F.exp(F.col("m") + F.col("w")).alias("upper"),
        (~F.col("base_failed") & inside).alias("kept"))
    zero = [F.lit(0).cast("long") for _ in range(5)]
    null = F.lit(None).cast("double")
    return scored.union(rest.select("doc_id", *zero, F.lit(True), null, null, null, F.lit(False)))
