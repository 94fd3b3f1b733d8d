"""Jaccard join over word shingles with adaptive multi-match prefixes.

Every text is a set of shingle hashes. All sets are read in one global order, rare shingles first:
a fixed-size count sketch over all documents gives each shingle a frequency class, and the hash
breaks ties. Two sets that meet the threshold share at least ``l`` shingles among their first
``n - ceil(t * n) + l``, whatever the order. Each document picks its own ``l``: a longer prefix
costs more index rows but needs more matches, and the sketch tells how many candidates either
choice would bring. A pair becomes a candidate when it shares as many prefix shingles as the
smaller of its two levels asks for.

* Copies (equal sets) collapse to their smallest id before anything is paired.
* The sketch cannot tell shingles apart that are rarer than what a cell holds by chance, and that
  grows with the corpus. So shingles that prove common in the index go to the end of the order, and
  the documents that had one in their prefix get another prefix.
* A shingle that is still in many prefixes (over ``bucket`` documents) is never paired within. It ties
  its documents to its smallest one, which costs one row each.
* Candidates and ties form families. A family is dealt into blocks of texts, bounded in texts and in
  shingles, and each pair of blocks is one bounded task that counts exact overlaps through an inverted
  list and returns a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell.llm import words as W
from deltacell.llm.graph import components
from deltacell.llm.ids import by_ids
from deltacell.session import settle

CHUNKS = 64
#: Rounds that move common shingles to the end of the order, and how many of them go to the tasks at most (16 bytes
#: each). Both change candidates only, never the links.
ROUNDS, COMMON = 2, 1_000_000
#: Ranks of shingles found common begin here, above all classes of the sketch.
LAST = 64
#: Shingles in a block of texts.
BLOCK_SHINGLES = 400_000


def set_keys(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_key): equal sets have equal keys; an empty set has none."""
    def run(batches):
        for batch in W.slices(batches):
            raw, offsets = W.buffers(batch.column(1))
            keys, counts = [], []
            for a, b in W.runs(offsets):
                values, first = W.shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                counts.append(np.diff(first))
                keys += [
                    hashlib.blake2b(values[i:j].tobytes(), digest_size=16).digest() if j > i else None
                    for i, j in zip(first[:-1], first[1:], strict=True)
                ]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary())],
                                             ["doc_id", "n_shingles", "set_key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary")


def count_sketch(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """Occurrences of shingles over all texts in ``2 ** bits`` cells, chosen by the hash's top bits.

    Tasks send their cells in chunks; chunks are summed in three levels of bounded groups. The
    result has a fixed size, whatever the input.
    """
    per = (1 << bits) // CHUNKS

    def local(batches):
        from pyspark import TaskContext

        cells = np.zeros(1 << bits, np.int64)
        for batch in W.slices(batches):
            raw, offsets = W.buffers(batch.column(0))
            for a, b in W.runs(offsets):
                values, _ = W.shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                np.add.at(cells, (values >> W.U(64 - bits)).astype(np.int64), 1)
        part = TaskContext.get().partitionId()
        for k in range(CHUNKS):
            own = cells[k * per:(k + 1) * per]
            if own.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([_pack(own)], pa.binary())],
                    ["chunk", "part", "cells"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for x in table.column("cells"):
            total += _unpack(x.as_py(), per)
        return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1],
                         "cells": pa.array([_pack(total)], pa.binary())})

    schema = "chunk int, part int, cells binary"
    sums = docs.select("text").mapInArrow(local, schema)
    for groups in (1024, 32, 1):
        sums = sums.withColumn("part", F.col("part") % groups).groupBy("chunk", "part").applyInArrow(merge, schema)
    out = np.zeros((CHUNKS, per), np.int64)
    for row in sums.collect():
        out[row["chunk"]] = _unpack(row["cells"], per)
    return out.ravel()


def _pack(cells: np.ndarray) -> bytes:
    at = np.flatnonzero(cells)
    if 3 * len(at) > len(cells):
        kind = np.uint16 if cells.max() < 1 << 16 else np.int64
        return (b"h" if kind is np.uint16 else b"q") + cells.astype(kind).tobytes()
    return b"s" + at.astype(np.uint32).tobytes() + cells[at].astype(np.int64).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    if data[:1] != b"s":
        return np.frombuffer(data, np.uint16 if data[:1] == b"h" else np.int64, -1, 1).astype(np.int64)
    k = (len(data) - 1) // 12
    out = np.zeros(n, np.int64)
    out[np.frombuffer(data, np.uint32, k, 1)] = np.frombuffer(data, np.int64, k, 1 + 4 * k)
    return out


def _classes(counts: np.ndarray) -> np.ndarray:
    """Frequency class of each cell: 0 up to what a cell holds by chance, then by powers of two."""
    usual = float(np.median(counts))
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / (usual + 4 * math.sqrt(usual) + 1)) + 1)).astype(np.uint8)


def prefixes(docs: DataFrame, classes, size: int, percent: int, bits: int, levels: int, common=None) -> DataFrame:
    """Index rows (token, node, size): each document's adaptive prefix; ``size`` is 16 n + level.

    ``classes`` is the broadcast sketch, ``common`` that of tokens in ascending order and their ranks,
    which come before the sketch. For level ``l`` the cost is the expected length of the
    prefix's lists plus four times the candidates that can match ``l`` of them.
    """
    def run(batches):
        weight = 2.0 ** np.concatenate([np.arange(LAST).clip(0, 60), np.arange(256 - LAST).clip(0, 60)])
        table = classes.value
        known, ranks = common.value if common is not None else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        for batch in W.slices(batches):
            raw, offsets = W.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in W.runs(offsets):
                values, first = W.shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                cls = table[(values >> W.U(64 - bits)).astype(np.int64)]
                if len(known):
                    at = np.searchsorted(known, values).clip(max=len(known) - 1)
                    cls = np.where(known[at] == values, ranks[at], cls)
                order = np.lexsort((values, cls, owner)) if cls.any() else np.arange(len(values))
                values, cost = values[order], np.concatenate([[0.0], np.cumsum(weight[cls[order]])])
                need = -(-percent * n // 100)
                best, level = np.full(len(n), np.inf), np.ones(len(n), np.int64)
                for l in range(1, levels + 1):
                    fits = l <= need
                    end = first[:-1] + np.minimum(n, n - need + l)
                    lists = cost[end] - cost[first[:-1]]
                    now = np.where(fits, lists + 4 * lists / l, np.inf)
                    level = np.where(now < best, l, level)
                    best = np.minimum(now, best)
                length = np.where(n > 0, n - need + level, 0)
                keep = np.arange(len(values)) - first[:-1][owner] < length[owner]
                who = owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[keep].view(np.int64)), pa.array(ids[a:b][who], pa.int64()),
                     pa.array(16 * n[who] + level[who])], ["token", "node", "size"])

    return docs.select("doc_id", "text").mapInArrow(run, "token long, node long, size long")


def refined(docs: DataFrame, index: DataFrame, again, bucket: int) -> DataFrame:
    """``index`` with the prefixes of documents that held common tokens taken anew.

    ``again(docs, common)`` gives the index rows of some documents under an order that puts the tokens
    ``common`` last. A token keeps its rank once it has one, and every document with a new one in its
    prefix is taken again, so all prefixes follow the last order: the others are the same under it.
    """
    parts, known = [index], (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    for _ in range(ROUNDS):
        # Later rounds look at the new prefixes only, where tokens come in that were not in any before.
        often = parts[-1].groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > bucket)
        often = settle(often.orderBy(F.desc("c"), "token").limit(COMMON))
        table = often.toArrow()
        tokens = table.column("token").to_numpy().view(np.uint64)
        ranks = (LAST + np.floor(np.log2(table.column("c").to_numpy()))).astype(np.uint8)
        fresh = ~np.isin(tokens, known[0])
        if not fresh.any() or len(known[0]) + fresh.sum() > COMMON:
            break
        tokens, ranks = np.concatenate([known[0], tokens[fresh]]), np.concatenate([known[1], ranks[fresh]])
        order = np.argsort(tokens)
        known = tokens[order], ranks[order]
        nodes = parts[0].join(F.broadcast(often), "token", "left_semi").select("node")
        for part in parts[1:]:
            nodes = nodes.union(part.join(F.broadcast(often), "token", "left_semi").select("node"))
        nodes = settle(nodes.distinct())
        held = by_ids(docs, nodes.withColumnRenamed("node", "doc_id"), "left_semi")
        common = docs.sparkSession.sparkContext.broadcast(known)
        parts = [by_ids(part, nodes, "left_anti", "node") for part in parts] + [settle(again(held, common))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part.select(*out.columns))
    return out


def block_links(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Links among the texts of one pair of blocks: exact set overlap, reduced to a spanning forest."""
    ids = table.column("node").to_numpy()
    side = table.column("side").to_numpy()
    raw, offsets = W.buffers(table.column("text"))
    sets = []
    for a, b in W.runs(offsets):
        values, first = W.shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
        sets += [values[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    tokens, at = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(at, kind="stable")
    posts, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(tokens)))])
    first = np.concatenate([[0], np.cumsum(n)])
    parent = list(range(len(n)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in range(len(n)):
        mine = at[first[x]:first[x + 1]]
        near = np.concatenate([posts[start[t]:start[t + 1]] for t in mine]) if len(mine) else posts[:0]
        shared = np.bincount(near, minlength=len(n))
        linked = 100 * shared >= percent * (n[x] + n - shared)
        linked &= (n > 0) & (np.arange(len(n)) > x) & ((side != side[x]) | (side == 2))
        for y in np.flatnonzero(linked):
            p, q = root(x), root(int(y))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((ids[x], ids[y]))
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


def jaccard_components(
    docs: DataFrame, size: int = 4, percent: int = 85, bits: int = 22, levels: int = 8, bucket: int = 64, block: int = 256,
    weight: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Two documents link when
    ``100 * |A and B| >= percent * |A or B|``. A null or empty text and one of white space only
    has no shingle and no link: it is its own component. Repeated rows give repeated rows. A row
    without doc_id links nothing; it gets the component of its copies that have an id, else null.
    An empty table gives an empty table.
    """
    W.text_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = settle(set_keys(docs, size))
    groups = settle(
        keys.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    )
    repeated = groups.where("copies > 1").select("set_key", "node")
    copies = keys.join(repeated, "set_key").where("node <> doc_id").select("doc_id")
    single = by_ids(docs.where("doc_id is not null"), copies, "left_anti", reused=True)

    classes = docs.sparkSession.sparkContext.broadcast(_classes(count_sketch(single, size, bits)))
    index = settle(prefixes(single, classes, size, percent, bits, levels))
    index = refined(single, index, lambda held, common: prefixes(held, classes, size, percent, bits, levels, common), bucket)
    live = index.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = settle(index.join(live, "token"))

    small = rows.where(F.col("c") <= bucket).withColumns({"n": F.shiftright("size", 4), "level": F.col("size") % 16})
    a = small.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("level").alias("la"))
    b = small.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("level").alias("lb"))
    meet = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = (
        a.join(b, (a["token"] == b["token"]) & meet).groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("la", "lb")).alias("level")).where("shared >= level").select("a", "b")
    )
    common = rows.where(F.col("c") > bucket)
    tie = common.groupBy("token").agg(F.min("node").alias("b"))
    ties = common.join(tie, "token").select(F.col("node").alias("a"), "b").distinct()
    found = settle(components(pairs.union(ties)))
    family = settle(found.union(found.select(F.col("root").alias("node"), "root").distinct()))

    sizes = keys.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n_shingles").alias("n"))
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n") / F.lit(weight)))
    blocks = family.join(sizes, "node").groupBy("root").agg(needed.cast("int").alias("k"))
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    dealt = family.join(blocks, "root").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    dealt = dealt.select(
        "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
    )
    texts = by_ids(single.withColumnRenamed("doc_id", "node"), family.select("node"), "left_semi", "node").join(dealt, "node")
    links = texts.groupBy("root", "i", "j").applyInArrow(
        lambda t: block_links(t, size, percent), "a long, b long"
    )
    roots = settle(components(links))
    groups = groups.join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id"))
    out = keys.join(groups, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
