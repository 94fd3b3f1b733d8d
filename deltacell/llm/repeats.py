"""Repeated paragraphs and passages across documents.

Paragraphs (lines) of enough words are compared by MinHash over five-word shingles. Bands are tuned
so that a pair at the wanted similarity collides almost surely. Colliding paragraphs form families;
families are dealt into pairs of bounded blocks, where exact Jaccard overlaps are counted, and the
links' components are the clusters. Equal paragraphs are one text throughout.

A passage inside longer paragraphs is found from winnowed seeds of half a window's words: of the
seeds inside any ``window`` words the one with the smallest hash is kept, so any run of ``window``
shared words shares a kept seed. A window stands for its smallest seed, the first of equal ones, which
is kept wherever the window is. If all places of a seed have the same words around them, its windows
are shared as the seed is, and a document's run of them is one row; only windows of other repeated
seeds are compared one by one. Either gives the exact first and last word of what is shared. Overlapping repeated windows of a document
are one span, those that an earlier document holds apart from those that stand here first. A cluster's or passage's smallest doc_id keeps it; it is a removal elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltacell.llm import words as W
from deltacell.llm.graph import components
from deltacell.llm.ids import FEW, by_ids
from deltacell.llm.ngram_join import block_links
from deltacell.session import settle

_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def tuned_bands(similarity: float, recall: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows): of the shapes that reach ``recall`` at ``similarity`` the one with the fewest
    expected collisions at half of it, each band costing as much as a collision in ten."""
    shapes = []
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))
        if bands * rows <= most:
            shapes.append((1 - (1 - (similarity / 2) ** rows) ** bands + bands / 10, bands, rows))
    return min(shapes)[1:]


def lines_of(raw: np.ndarray, offsets: np.ndarray, least: int):
    """Lines of at least ``least`` words: byte spans, text, first and last word; and all word hashes with each text's first."""
    low = W._LOWER[raw]
    starts, ends, first = W.word_spans(low, offsets)
    hashes = W.span_hashes(low, starts, ends)
    heads = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(raw == 10) + 1]))
    heads = heads[heads < len(raw)]
    tails = np.concatenate([heads[1:], [len(raw)]]) if len(heads) else heads
    a, b = np.searchsorted(starts, heads), np.searchsorted(starts, tails)
    long = b - a >= least
    owner = np.searchsorted(offsets, heads[long], "right") - 1
    return heads[long], tails[long], owner, a[long], b[long], hashes, first


def sequence_hashes(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of words, from prefix sums."""
    forward, backward = W._power_table(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * forward[:len(hashes)])])
    return W.mix((sums[ends] - sums[begins]) * backward[begins] + (ends - begins).astype(np.uint64))


def band_keys(grams: np.ndarray, begins: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of the shingles from each begin to its end, one row a line: minima of whole runs, not line by line."""
    bounds = np.stack([begins, ends], 1).ravel()
    padded = np.append(grams, np.uint64(0))
    low = [np.minimum.reduceat(W.mix(padded * _SEEDS[k]), bounds)[::2] for k in range(bands * rows)]
    keys = np.empty((len(begins), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(begins), band, np.uint64)
        for value in low[band * rows:(band + 1) * rows]:
            key = W.mix(key * W._MUL[4] + value)
        keys[:, band] = key
    return keys


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """Best of every ``size`` consecutive values, by doubling."""
    width = 1
    while 2 * width <= size:
        x = best(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return best(x[:len(x) - rest], x[rest:]) if rest else x


def winnowed(grams: np.ndarray, size: int) -> np.ndarray:
    """Positions whose value is the smallest of some ``size`` consecutive ones; of a shorter row the smallest of all."""
    if len(grams) <= size:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)
    least = _sliding(grams, size, np.minimum)
    padded = np.concatenate([np.zeros(size - 1, np.uint64), least, np.zeros(size - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, size, np.maximum) == grams)


def units(docs: DataFrame, least: int, seed: int, width: int) -> DataFrame:
    """(doc_id, kind, first, n_words, unit, around): lines (kind 0, ``first`` is the first word) and kept seeds (kind 1), the least
    of every ``width``; ``around`` is a hash of the words that any window over the seed can hold, and of how many precede it."""
    def run(batches):
        for batch in W.slices(batches):
            raw, offsets = W.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in W.runs(offsets):
                offs = offsets[a:b + 1] - offsets[a]
                _, _, owner, begin, end, hashes, first = lines_of(raw[offsets[a]:offsets[b]], offs, least)
                at = np.arange(max(0, len(hashes) - seed + 1))
                grams = sequence_hashes(hashes, at, at + seed) if len(at) else np.zeros(0, np.uint64)
                kept = [first[i] + winnowed(grams[first[i]:max(first[i], first[i + 1] - seed + 1)], width) for i in range(b - a)]
                who = np.repeat(np.arange(b - a), [len(k) for k in kept])
                kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                docs_of = np.concatenate([owner, who])
                left = np.maximum(kept - (width - 1), first[who])
                around = sequence_hashes(hashes, left, np.minimum(kept + seed + width - 1, first[who + 1]))
                around = (W.mix(around + (kept - left).astype(np.uint64) * W._MUL[2]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][docs_of], pa.int64()),
                     pa.array(np.repeat(np.array([0, 1], np.int32), [len(owner), len(who)])),
                     pa.array((np.concatenate([begin, kept]) - first[docs_of]).astype(np.int32)),
                     pa.array(np.concatenate([end - begin, np.full(len(kept), seed)]).astype(np.int32)),
                     pa.array(np.concatenate([sequence_hashes(hashes, begin, end), grams[kept]]).view(np.int64)),
                     pa.concat_arrays([pa.nulls(len(owner), pa.int32()), pa.array(around)])],
                    ["doc_id", "kind", "first", "n_words", "unit", "around"])

    return docs.mapInArrow(run, "doc_id long, kind int, first int, n_words int, unit long, around int")


def gather(live: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted seeds, their keepers, and whether they have one: 17 bytes a seed. Tasks pack them."""
    def packed(batches):
        for batch in batches:
            keeper = batch.column(1)
            columns = (batch.column(0).to_numpy(), keeper.fill_null(0).to_numpy(), keeper.is_valid().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["unit", "keeper", "known"])

    rows = live.select("unit", "keeper").mapInArrow(packed, "unit binary, keeper binary, known binary").collect()
    unit, keeper, known = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("unit", np.uint64), ("keeper", np.int64), ("known", bool)))
    order = np.argsort(unit)
    return unit[order], keeper[order], known[order]


def given_seeds(grams: np.ndarray, standing: np.ndarray, first: np.ndarray, seed: int, at: pa.Array):
    """Number of each window's seed among those given with the texts (-1: none), their keepers, and whether they have one."""
    place, unit, keeper = at.flatten().flatten()
    own = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
    place, unit = place.to_numpy() + first[own], unit.to_numpy().view(np.uint64)
    # Rows that share a doc_id have the seeds of both.
    fits = np.flatnonzero(place + seed <= first[own + 1])
    fits = fits[grams[place[fits]] == unit[fits]]
    number = np.full(len(grams), -1)
    number[place[fits]] = fits
    return number[standing], keeper.fill_null(0).to_numpy(), keeper.is_valid().to_numpy(zero_copy_only=False)


def known_seeds(grams: np.ndarray, standing: np.ndarray, shared: tuple):
    """The same by look-up in sorted seeds, once for the windows that follow each other with one seed."""
    units, keeper, known = shared
    heads = np.flatnonzero(np.diff(standing, prepend=-1))
    wanted = grams[standing[heads]]
    at = np.searchsorted(units, wanted).clip(max=max(0, len(units) - 1))
    hit = np.where(units[at] == wanted, at, -1) if len(units) else np.full(len(at), -1)
    return np.repeat(hit, np.diff(heads, append=len(standing))), keeper, known


def windows(docs: DataFrame, live: DataFrame, kept: DataFrame, seed: int, window: int, few: int) -> DataFrame:
    """(doc_id, first, n_words, unit, keeper) of the windows whose smallest seed is ``live`` (unit, keeper).

    Where the seed has a keeper, a run of windows that have the same one is a row without unit; else every
    window is a row with its hash. Up to ``few`` live seeds are sent to every executor and no text moves;
    beyond that texts meet their ``kept`` seeds (doc_id, first, unit) in a join, with the same result.
    """
    width = window - seed + 1
    broadcast = docs.sparkSession.sparkContext.broadcast(gather(live)) if live.count() <= few else None

    def run(batches):
        for batch in W.slices(batches):
            raw, offsets = W.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in W.runs(offsets):
                hashes, first = W.hashed_words(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                if len(hashes) < window:
                    continue
                begin = np.arange(len(hashes) - seed + 1)
                grams = sequence_hashes(hashes, begin, begin + seed)
                least = _sliding(grams, width, np.minimum)
                standing = np.zeros(len(least), np.int64)
                for k in range(width - 1, -1, -1):
                    standing[grams[k:k + len(least)] == least] = k
                begin = np.arange(len(least))
                standing += begin
                if broadcast is None:
                    seen, keeper, known = given_seeds(grams, standing, first, seed, batch.column(2).slice(a, b - a))
                else:
                    seen, keeper, known = known_seeds(grams, standing, broadcast.value)
                who = np.searchsorted(first, begin, "right") - 1
                live = np.flatnonzero((seen >= 0) & (begin + window <= first[who + 1]))
                begin, who, seen = live, who[live], seen[live]
                alone = ~known[seen]
                more = np.flatnonzero(~alone)
                w, d, k = begin[more], who[more], keeper[seen[more]]
                heads = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 1) | (np.diff(d) != 0) | (np.diff(k) != 0)])[:len(w)])
                tails = np.concatenate([heads[1:], [len(w)]])[:len(heads)] - 1
                n = int(alone.sum())
                start, doc = np.concatenate([begin[alone], w[heads]]), np.concatenate([who[alone], d[heads]])
                size = np.concatenate([np.full(n, window), w[tails] - w[heads] + window])
                absent = np.repeat([False, True], [n, len(heads)])
                units = sequence_hashes(hashes, start, np.minimum(start + window, len(hashes))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][doc], pa.int64()), pa.array((start - first[doc]).astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.array(units, mask=absent), pa.array(np.concatenate([np.zeros(n, np.int64), k[heads]]), mask=~absent)],
                    ["doc_id", "first", "n_words", "unit", "keeper"])

    given = docs.select("doc_id", "text")
    if broadcast is None:
        seeds = kept.join(live, "unit").groupBy("doc_id").agg(F.collect_set(F.struct("first", "unit", "keeper")).alias("at"))
        given = given.join(seeds, "doc_id").select("doc_id", "text", "at")
    return given.mapInArrow(run, "doc_id long, first int, n_words int, unit long, keeper long")


def bands(docs: DataFrame, least: int, size: int, shape: tuple[int, int]) -> DataFrame:
    """Distinct (key, unit) of lines; equal lines of a run of texts are hashed once. A line has a shingle at least."""
    def run(batches):
        for batch in W.slices(batches):
            raw, offsets = W.buffers(batch.column(0))
            keys, owners = [], []
            for a, b in W.runs(offsets):
                _, _, _, begin, end, hashes, _ = lines_of(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], least)
                values = sequence_hashes(hashes, begin, end)
                once = np.sort(np.unique(values, return_index=True)[1])
                values, begin, end = values[once], begin[once], end[once]
                if len(once):
                    keys.append(band_keys(W.window_hashes(hashes, size), begin, end - size + 1, *shape).ravel())
                    owners.append(np.repeat(values, shape[0]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64))],
                                                 ["key", "unit"])

    return docs.select("text").mapInArrow(run, "key long, unit long")


def line_texts(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, unit, text) of lines."""
    def run(batches):
        for batch in W.slices(batches):
            raw, offsets = W.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in W.runs(offsets):
                part = raw[offsets[a]:offsets[b]]
                heads, tails, owner, begin, end, hashes, _ = lines_of(part, offsets[a:b + 1] - offsets[a], least)
                data = part.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][owner], pa.int64()), pa.array(sequence_hashes(hashes, begin, end).view(np.int64)),
                     pa.array([data[i:j].decode("utf-8", "replace") for i, j in zip(heads, tails, strict=True)], pa.string())],
                    ["doc_id", "unit", "text"])

    return docs.mapInArrow(run, "doc_id long, unit long, text string")


def near_lines(docs: DataFrame, every: DataFrame, least: int, size: int, percent: int, recall: float, block: int) -> DataFrame:
    """(node, root) of lines that have a similar line with a smaller hash."""
    keys = settle(bands(docs, least, size, tuned_bands(percent / 100, recall)).distinct())
    live = keys.groupBy("key").agg(F.min("unit").alias("tie"), F.max("unit").alias("_top")).where("tie <> _top").select("key", "tie")
    edges = keys.join(live, "key").where("unit <> tie").select(F.col("unit").alias("a"), F.col("tie").alias("b")).distinct()
    found = settle(components(edges))
    family = settle(found.union(found.select(F.col("root").alias("node"), "root").distinct()))
    sizes = family.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("k"))
    dealt = family.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, k - 1)"))).select(
        "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
    # One document of each line is read again.
    holder = settle(every.where("kind = 0").join(family.select(F.col("node").alias("unit")), "unit").groupBy("unit").agg(F.min("doc_id").alias("doc_id")))
    some = by_ids(docs, holder.select("doc_id"), "left_semi")
    texts = line_texts(some.select("doc_id", "text"), least).join(holder, ["doc_id", "unit"])
    texts = texts.groupBy(F.col("unit").alias("node")).agg(F.first("text").alias("text"))
    links = texts.join(dealt, "node").groupBy("root", "i", "j").applyInArrow(
        lambda t: block_links(t, size, percent), "a long, b long")
    return settle(components(links))


def repeats(
    docs: DataFrame, least: int = 5, size: int = 5, percent: int = 80, recall: float = 0.995, window: int = 24, block: int = 256,
    few: int = 4 * FEW,
) -> DataFrame:
    """Repeated parts: doc_id, kind (paragraph or passage), first_word, n_words, cluster, keeper, removed.

    Only parts that stand in at least two documents are returned. ``keeper`` is the smallest doc_id
    that has the part, ``removed`` says that this is another one, ``cluster`` names a paragraph's
    cluster. Every run of ``window`` or more words that stands in two documents is in a passage. Words are lower-cased for A-Z. Paragraphs under ``least`` words (at least ``size``) are not
    compared. Null and empty texts and rows without doc_id have no part; repeated rows of one doc_id are one
    document; an empty table gives an empty table. Other columns are ignored.
    """
    W.text_batches(docs)
    least = max(least, size)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    seed = max(1, window // 2)
    # Seeds are read off the texts again rather than written: they are the largest table here.
    parts = units(docs, least, seed, window - seed + 1)
    every = settle(parts.where("kind = 0").drop("around"))
    roots = near_lines(docs, every, least, size, percent, recall, block)
    lines = every.where("kind = 0").join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    kept = parts.where("kind = 1").select("doc_id", "first", "unit", "around")
    live = kept.groupBy("unit").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_top"), F.min("around").alias("_a"), F.max("around").alias("_b"))
    live = live.where("_low <> _top").select("unit", F.when(F.col("_a") == F.col("_b"), F.col("_low")).alias("keeper"))
    found = settle(windows(docs, settle(live), kept.drop("around"), seed, window, few))

    def shared(rows, key):
        low = rows.groupBy(key).agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_top")).where("keeper <> _top").drop("_top")
        return rows.join(low, key)

    paragraphs = shared(lines.select("doc_id", "first", "n_words", "root"), "root").distinct().select(
        "doc_id", F.lit("paragraph").alias("kind"), F.col("first").alias("first_word"), "n_words", F.col("root").alias("cluster"), "keeper")
    hit = shared(found.where("keeper is null").select("doc_id", "first", "n_words", "unit"), "unit").select("doc_id", "first", "n_words", "keeper").union(
        found.where("keeper is not null").select("doc_id", "first", "n_words", "keeper"))
    before = Window.partitionBy("doc_id", "_gone").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "_gone").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    # What stands here first is never part of a removed span.
    islands = hit.withColumn("_gone", F.col("keeper") < F.col("doc_id")).withColumn("_end", F.max(F.col("first") + F.col("n_words")).over(before))
    islands = islands.withColumn("_new", F.coalesce(F.col("first") > F.col("_end"), F.lit(True)).cast("int")).withColumn("_k", F.sum("_new").over(upto))
    passages = islands.groupBy("doc_id", "_gone", "_k").agg(
        F.min("first").alias("first_word"), (F.max(F.col("first") + F.col("n_words")) - F.min("first")).alias("n_words"),
        F.min("keeper").alias("keeper"))
    passages = passages.select("doc_id", F.lit("passage").alias("kind"), "first_word", "n_words", F.lit(None).cast("long").alias("cluster"), "keeper")
    return paragraphs.union(passages).withColumn("removed", F.col("keeper") < F.col("doc_id"))
