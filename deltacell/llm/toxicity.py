"""Toxicity scores from a learnt lexicon, matched with spelling errors and weighed by context.

1. A bounded sample of labelled rows gives the lexicon: all words whose presence speaks for the
   label beyond chance, and stems, which stand for any word beginning with them, where a stem meets
   clearly more positives than its best word.
2. The lexicon's trie is intersected with Levenshtein automata, where two exchanged neighbours count
   as one edit and a stem has edits within its own letters. The product is made deterministic
   once, so a task steps all words of a batch through one table, and words that can no longer match
   drop out after a few letters.
3. Each hit is weighed by its term, its spelling distance and its context: a hit within quotation
   marks counts apart from one outside, and hits are summed over a window of words.
4. A logistic model over these sums, fitted on the same sample, gives the score.

Labels are read for learning only; a score depends on the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltacell.llm import words as W

_WORD = re.compile(r"[^\W_]+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
STEM_SIZES = (4, 5, 6, 7, 8)
#: A stem is taken only if it meets so many times the positives of its best word.
STEM_ADDS = 1.5
QUOTES = ('"', "“", "”", "„", "«", "»")
_QUOTE = re.compile(b"|".join(q.encode() for q in QUOTES))
#: (least letters, edits): shorter terms must match exactly.
EDITS = ((9, 2), (5, 1))
FEATURES = 5


@dataclass
class Automaton:
    """Deterministic product of a lexicon's trie and its Levenshtein automata, over bytes."""

    table: np.ndarray
    classes: np.ndarray
    weight: np.ndarray
    edits: np.ndarray


def _edits(term: str) -> int:
    if not term.isascii():
        return 0
    return next((d for least, d in EDITS if len(term) >= least), 0)


def compile_lexicon(lexicon: dict[str, float], swaps: bool = False) -> Automaton:
    """Automaton of weighted terms; one that ends in ``*`` is a stem. State 0 is dead, 1 the start.

    A stem accepts a word if some beginning of it is within the stem's edits. With ``swaps`` two
    exchanged neighbours are one edit.
    """
    child: list[dict[int, int]] = [{}]
    limit, word, stem, parent, letter = [0], [None], [None], [0], [-1]
    for term, weight in sorted(lexicon.items()):
        text = term.rstrip("*")
        node, most = 0, _edits(text)
        limit[0] = max(limit[0], most)
        for byte in text.encode():
            if byte not in child[node]:
                child[node][byte] = len(child)
                child.append({})
                limit.append(0)
                word.append(None)
                stem.append(None)
                parent.append(node)
                letter.append(byte)
            node = child[node][byte]
            limit[node] = max(limit[node], most)
        (stem if term.endswith("*") else word)[node] = (weight, most)
    letters = sorted({b for c in child for b in c})
    classes = np.zeros(256, np.uint8)
    classes[letters] = np.arange(1, len(letters) + 1)
    # Numbers from ``half`` on stand half-way in an exchange: the second letter has been read, the first must follow.
    half = len(child)

    def closed(states: dict[int, int]) -> frozenset:
        """Add skipped letters of the term; keep the fewest edits of each node. A stem that has been
        read stands as the node's complement and stays."""
        out: dict[int, int] = {}
        heap = list(states.items())
        while heap:
            node, e = heap.pop()
            if node >= 0 and e > limit[node % half] or out.get(node, 99) <= e:
                continue
            out[node] = e
            if 0 <= node < half:
                if stem[node] and e <= stem[node][1]:
                    heap.append((~node, e))
                heap += [(c, e + 1) for c in child[node].values()]
        return frozenset(out.items())

    start = closed({0: 0})
    known, queue, rows = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters) + 1)]
    for states in queue:
        row = []
        for k in range(len(letters) + 1):
            step: dict[int, int] = {}

            def put(node, e, step=step):
                step[node] = min(e, step.get(node, 99))

            for node, e in states:
                if node < 0:
                    put(node, e)
                    continue
                if node >= half:
                    if k and letter[parent[node - half]] == letters[k - 1]:
                        put(node - half, e)
                    continue
                put(node, e + 1)
                for byte, c in child[node].items():
                    put(c, e if k and byte == letters[k - 1] else e + 1)
                    if swaps and k and byte != letters[k - 1] and letters[k - 1] in child[c]:
                        put(half + child[c][letters[k - 1]], e + 1)
            to = closed(step)
            if to not in known:
                known[to] = len(known)
                queue.append(to)
            row.append(known[to])
        rows.append(row)
    weight, edits = np.zeros(len(known)), np.zeros(len(known), np.int64)
    for states, at in known.items():
        found = [(e, -word[n][0]) for n, e in states if 0 <= n < half and word[n] and e <= word[n][1]]
        found += [(e, -stem[~n][0]) for n, e in states if n < 0]
        if found:
            e, w = min(found)
            weight[at], edits[at] = -w, e
    return Automaton(np.array(rows, np.int32), classes, weight, edits)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of letters and digits, and the text it is in."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _LETTER[raw]
    begins, ends = inside[:-1].copy(), inside[:-1] & ~inside[1:]
    begins[1:] &= ~inside[:-2]
    full = offsets[:-1] < offsets[1:]
    begins[offsets[:-1][full]] = inside[offsets[:-1][full]]
    ends[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def match(auto: Automaton, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final state of every word that the automaton accepts: (word index, state)."""
    alive, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
    found_word, found_state = [], []
    kinds = auto.classes[raw]
    while len(alive):
        over = at >= ends[alive]
        hit = over & (auto.weight[state] > 0)
        found_word.append(alive[hit])
        found_state.append(state[hit])
        alive, state, at = alive[~over], state[~over], at[~over]
        state = auto.table[state, kinds[at]]
        on = state > 0
        alive, state, at = alive[on], state[on], at[on] + 1
    index = np.concatenate(found_word) if found_word else np.zeros(0, np.int64)
    order = np.argsort(index, kind="stable")
    return index[order], (np.concatenate(found_state)[order] if found_state else np.zeros(0, np.int32))


def features(auto: Automaton, texts: pa.Array, window: int) -> np.ndarray:
    """Per text, as log(1 + x): exact, misspelt and quoted weight, the heaviest window, weight per 100 words."""
    lowered = pa.array([(t or "").lower() for t in texts.to_pylist()], pa.large_string())
    raw, offsets = W.buffers(lowered)
    out = np.zeros((len(offsets) - 1, FEATURES))
    for a, b in W.runs(offsets):
        part, offs = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, owner = word_spans(part, offs)
        index, state = match(auto, part, starts, ends)
        if not len(index):
            continue
        doc, weight, near = owner[index], auto.weight[state], auto.edits[state] > 0
        marks = np.array([m.start() for m in _QUOTE.finditer(part.tobytes())], np.int64)
        before = np.searchsorted(marks, starts[index]) - np.searchsorted(marks, offs[doc])
        after = np.searchsorted(marks, offs[doc + 1]) - np.searchsorted(marks, starts[index])
        quoted = (before % 2 == 1) & (after > 0)
        for k, which in enumerate((~near & ~quoted, near & ~quoted, quoted)):
            np.add.at(out[a:b, k], doc[which], weight[which])
        place = index + doc * (window + 1)
        counted = np.where(quoted, 0.0, np.where(near, weight / 2, weight))
        total = np.concatenate([[0.0], np.cumsum(counted)])
        heavy = total[np.searchsorted(place, place + window, "right")] - total[np.arange(len(place))]
        np.maximum.at(out[a:b, 3], doc, heavy)
        n_words = np.bincount(owner, minlength=b - a)
        np.add.at(out[a:b, 4], doc, 100 * counted / (n_words[doc] + 20))
    return np.log1p(out)


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(text, label) of at most ``toxic`` and ``clean`` labelled rows, those with the smallest hashes."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    picked = [
        known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic), (0, clean))
    ]
    few = picked[0].union(picked[1]).select("doc_id", F.col("toxic").cast("int").alias("label"))
    return docs.join(few, "doc_id").select("text", "label")


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms of the sample with their log odds. A term must be too frequent among positives to be chance.

    Every such word is a term, so it gets its edits; a stem is one where it meets clearly more
    positives than its best word. Of nested stems the one with the larger gain is taken.
    """
    def count(batches):
        seen: Counter = Counter()
        for batch in W.slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = {""}
                for w in set(_WORD.findall((text or "").lower())):
                    terms.add(w)
                    terms.update(f"{w[:k]}*" for k in STEM_SIZES if len(w) > k)
                seen.update((t, label) for t in terms)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.int32()),
             pa.array(list(seen.values()), pa.int64())], ["term", "label", "n"])

    counts = sample.mapInArrow(count, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"),
    )
    whole = counts.where("term = ''").first()
    if whole is None or not whole["t"] or not whole["c"]:
        return {}
    pos, neg = whole["t"], whole["c"]
    odds = F.log(((F.col("t") + 0.1) / pos) / ((F.col("c") + 0.5) / neg))
    chance = -math.log(pos / (pos + neg))
    strong = counts.where(f"term <> '' and t >= 3 and c * {20 * pos} <= t * {neg}").withColumn("odds", odds)
    strong = strong.where(F.col("t") * chance - 3 * F.col("c") > math.log(1e7)).withColumn("gain", F.col("t") * F.col("odds"))
    rows = strong.orderBy(F.desc("gain"), F.length("term").desc(), "term").collect()
    best: Counter = Counter()
    for row in rows:
        if not row["term"].endswith("*"):
            for k in STEM_SIZES:
                if len(row["term"]) > k:
                    best[row["term"][:k]] = max(best[row["term"][:k]], row["t"])
    lexicon: dict[str, float] = {}
    stems: list[str] = []
    for row in rows:
        text = row["term"].rstrip("*")
        if text != row["term"]:
            if row["t"] < STEM_ADDS * best[text] or any(text.startswith(x) or x.startswith(text) for x in stems):
                continue
            stems.append(text)
        lexicon[row["term"]] = float(row["odds"])
    return lexicon


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients, intercept last, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Model:
    automaton: Automaton
    beta: np.ndarray
    window: int


def learn(docs: DataFrame, labels: DataFrame, toxic: int = 3000, clean: int = 6000, window: int = 50) -> Model:
    """Fit on at most ``toxic + clean`` labelled rows; with labels of one kind only, every score is that share."""
    W.text_batches(docs)
    sample = labelled_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                             labels, toxic, clean)
    auto = compile_lexicon(learn_lexicon(sample), swaps=True)

    def measure(batches):
        for batch in W.slices(batches):
            x = features(auto, batch.column(0), window)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(FEATURES)), batch.column(1)], [*"abcde", "label"])

    rows = sample.mapInArrow(measure, "a double, b double, c double, d double, e double, label int").toPandas()
    y = rows["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 1))
        return Model(auto, np.array([0.0] * FEATURES + [base]), window)
    x = rows[list("abcde")].to_numpy()
    return Model(auto, fit_logistic(x, y), window)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1). Null and empty texts score as texts without a hit."""
    def run(batches):
        for batch in W.slices(batches):
            x = features(model.automaton, batch.column(at).cast(pa.string()), model.window)
            z = np.clip(x @ model.beta[:-1] + model.beta[-1], -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*batch.schema.names, "score"])

    W.text_batches(docs)
    kept = [f for f in docs.schema.fields if f.name != "score"]
    at = [f.name for f in kept].index("text")
    given = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    return given.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column | str) -> Column:
    """True where a row is kept from learning: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from a score of 0.5).

    Learns from labelled rows that are not held out. Null and empty texts get the score of a text
    without hits; repeated rows repeat; an empty table gives an empty table; without labels every
    score is the same and at most 0.5. Other columns are ignored.
    """
    model = learn(docs, labels.where(~held_out("doc_id")), **options)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
