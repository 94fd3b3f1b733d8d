"""Approximate nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component that makes them unit vectors,
so the largest inner product is the smallest distance. A table hashes a vector by slots
``floor((a . x + b) / w)`` along a few normal directions. For a query, every combination of slots
around its own has an estimated chance to hold a neighbour: a neighbour's projection is normal
around ``similarity`` times the query's. Buckets are visited from the best chance down until their
chances add up to ``reach``. What the tables find is merged, measured again on the original vectors
in double precision, and ranked.

Buckets are dealt in blocks of rows and queries of bounded size, whatever a bucket holds. Equal
vectors are one candidate with its smallest ids. Queries that find too few go on to all buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltacell.session import settle


@dataclass
class Tables:
    """Directions and slots of every table, and what is known of the data."""

    directions: list[np.ndarray]
    offsets: list[np.ndarray]
    width: float
    low: int
    slots: int
    scale: float
    similarity: float
    spread: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))])

    def digits(self, lifted: np.ndarray, t: int) -> np.ndarray:
        at = np.floor((lifted @ self.directions[t] + self.offsets[t]) / self.width).astype(np.int64) - self.low
        return at.clip(0, self.slots - 1)

    def code(self, digits: np.ndarray) -> np.ndarray:
        out = np.zeros(len(digits), np.int64)
        for i in range(digits.shape[1]):
            out = out * self.slots + digits[:, i]
        return out

    def chances(self, queries: np.ndarray, t: int) -> np.ndarray:
        """Estimated chance of every bucket of table ``t`` to hold a given neighbour of each query."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        at = np.column_stack([unit, np.zeros(len(unit))]) @ self.directions[t] * self.similarity
        edges = (np.arange(self.slots + 1) + self.low) * self.width
        out = np.ones((len(unit), 1))
        for i in range(at.shape[1]):
            z = (edges[None] - self.offsets[t][i] - at[:, i:i + 1]) / self.spread
            z[:, 0], z[:, -1] = -40, 40
            out = (out[:, :, None] * np.diff(_normal(z), axis=1)[:, None, :]).reshape(len(unit), -1)
        return out

    def probes(self, queries: np.ndarray, t: int, reach: float) -> list[np.ndarray]:
        """Buckets to visit, best first, until their chances add up to ``reach`` (1: all)."""
        chance = self.chances(queries, t)
        order = np.argsort(-chance, 1, kind="stable")
        if reach >= 1:
            return list(order)
        total = np.cumsum(np.take_along_axis(chance, order, 1), 1)
        return [o[:k] for o, k in zip(order, (total < reach).sum(1) + 1, strict=True)]


def _normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of vectors that take part: not null or zero, every component there and finite, of the usual length."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    sound = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    usual = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.where(F.size("v") == F.lit(usual["n"] if usual else 0))


def fit(distinct: DataFrame, n_tables: int, hashes: int, width: float, sample: int, seed: int, top: int) -> Tables | None:
    """Random directions, and the expected similarity of a wanted neighbour from ``sample`` rows (those of smallest hash)."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    whole = distinct.agg(F.max(norm).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        return None
    some = np.array([r["v"] for r in distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()])
    d, rng = some.shape[1], np.random.default_rng(seed)
    unit = some / np.linalg.norm(some, axis=1, keepdims=True)
    asked = unit[:128]
    near = np.sort(asked @ (some / whole["m"]).T, 1)[:, ::-1]
    rank = min(near.shape[1] - 1, max(1, round(top * len(some) / whole["n"])))
    similarity = float(np.clip(near[:, rank].mean(), 0.0, 0.999))
    directions, offsets, spread = [], [], math.sqrt((1 - similarity ** 2) / d)
    step = width / math.sqrt(d)
    for _ in range(n_tables):
        a = np.linalg.qr(rng.normal(size=(d + 1, min(hashes, d + 1))))[0]
        directions.append(a)
        offsets.append(rng.uniform(0, step, a.shape[1]))
    low = math.floor(-2.2 / math.sqrt(d) / step)
    slots = math.floor((2.2 / math.sqrt(d) + step) / step) - low + 1
    return Tables(directions, offsets, step, low, slots, float(whole["m"]), similarity, spread)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def search_block(key, rows: pa.Table, asked: pa.Table, keep: int) -> pa.Table:
    """Best ``keep`` rows of one block for each query of one block, among the buckets that the query visits."""
    out_q, out_g, out_s = [], [], []
    if rows.num_rows and asked.num_rows:
        x, codes = _matrix(rows.column("v")), rows.column("code").to_numpy()
        local, place = np.unique(codes, return_inverse=True)
        gids, qids = rows.column("gid").to_numpy(), asked.column("query_id").to_numpy()
        q, visits = _matrix(asked.column("v")), asked.column("codes").combine_chunks()
        first, flat = np.asarray(visits.offsets), visits.values.to_numpy()
        for a in range(0, len(q), 256):
            b = min(len(q), a + 256)
            allowed = np.zeros((b - a, len(local)), bool)
            some = flat[first[a]:first[b]]
            owner = np.repeat(np.arange(b - a), np.diff(first[a:b + 1]))
            at = np.searchsorted(local, some).clip(max=len(local) - 1)
            hit = local[at] == some
            allowed[owner[hit], at[hit]] = True
            score = np.where(allowed[:, place], q[a:b] @ x.T, -np.inf)
            k = min(keep, len(x))
            best = np.argpartition(-score, k - 1, 1)[:, :k]
            value = np.take_along_axis(score, best, 1)
            i, j = np.nonzero(value > -np.inf)
            out_q.append(qids[a:b][i])
            out_g.append(gids[best[i, j]])
            out_s.append(value[i, j])
    join = (lambda p, kind: np.concatenate(p) if p else np.zeros(0, kind))
    return pa.table({"query_id": pa.array(join(out_q, np.int64), pa.int64()), "gid": pa.array(join(out_g, np.int64), pa.int64()),
                     "near": pa.array(join(out_s, float), pa.float64())})


def candidates(distinct: DataFrame, queries: DataFrame, tables: Tables, reach: float, keep: int, block: int) -> DataFrame:
    """Distinct (query_id, gid, near) that the tables find."""
    lead = tables.slots ** max(0, tables.directions[0].shape[1] - 2)
    shared = distinct.sparkSession.sparkContext.broadcast(tables)

    def place(batches):
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lifted = model.lifted(_matrix(batch.column(1)))
            for t in range(len(model.directions)):
                code = model.code(model.digits(lifted, t))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(code), t, np.int32)), pa.array(code), pa.array(code // lead)],
                    ["gid", "v", "t", "code", "part"])

    def ask(batches):
        model = shared.value
        for batch in batches:
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, 1))
            for a in range(0, len(x), 512):
                for t in range(len(model.directions)):
                    at, part, codes = [], [], []
                    for i, visit in enumerate(model.probes(x[a:a + 512], t, reach)):
                        visit = np.sort(visit)
                        parts, start = np.unique(visit // lead, return_index=True)
                        at += [a + i] * len(parts)
                        part += parts.tolist()
                        codes += np.split(visit, start[1:])
                    sizes = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), t, np.int32)),
                         pa.array(part, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(codes)))],
                        ["query_id", "v", "t", "part", "codes"])

    rows = distinct.select("gid", "v").mapInArrow(place, "gid long, v array<double>, t int, code long, part long")
    counts = settle(rows.groupBy("t", "part").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("k")))
    m = F.lit(max(1, -(-queries.count() // block)))
    rows = rows.join(counts, ["t", "part"]).withColumn("i", F.pmod(F.xxhash64("gid"), "k").cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), m - 1))).select("t", "part", "i", "j", "gid", "v", "code")
    asked = queries.select("query_id", "v").mapInArrow(ask, "query_id long, v array<double>, t int, part long, codes array<long>")
    asked = asked.join(counts, ["t", "part"]).withColumn("j", F.pmod(F.xxhash64("query_id"), m).cast("int"))
    asked = asked.withColumn("i", F.explode(F.expr("sequence(0, k - 1)"))).select("t", "part", "i", "j", "query_id", "v", "codes")
    key = ["t", "part", "i", "j"]
    found = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
        lambda k, a, b: search_block(k, a, b, keep), "query_id long, gid long, near double")
    return found.groupBy("query_id", "gid").agg(F.max("near").alias("near"))


def nearest(
    vectors: DataFrame, queries: DataFrame, top: int = 20, n_tables: int = 2, hashes: int = 6, width: float = 2.5, reach: float = 0.75,
    sample: int = 4096, block: int = 4096, seed: int = 11,
) -> DataFrame:
    """Each query's ``top`` nearest rows found: query_id, rank (from 1), vec_id, score.

    Both tables need vec_id and embedding; other columns are ignored. Nearness is the inner product
    of the original vectors in double precision, summed in order; ties go to the smaller vec_id; a
    query's own vec_id is no candidate. Vectors that are null or zero, hold null or non-finite
    components, have no vec_id or an unusual length take no part. A repeated vec_id counts once for
    equal vectors. With fewer candidates than ``top``, all are returned; empty tables give none.
    """
    rows = usable(vectors)
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.dropDuplicates(["v", "vec_id"]).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top + 1)
    distinct = few.groupBy("v").agg(F.min("vec_id").alias("gid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = settle(distinct.groupBy("gid", "v").agg(F.first("ids").alias("ids")))
    asked = usable(queries).withColumnRenamed("vec_id", "query_id")
    asked = settle(asked.groupBy("query_id").agg(F.min("v").alias("v")))
    tables = fit(distinct, n_tables, hashes, width, sample, seed, top)
    spark = vectors.sparkSession
    if tables is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    keep = top + 4
    found = settle(candidates(distinct, asked, tables, reach, keep, block))
    enough = found.groupBy("query_id").count().where(F.col("count") > top)
    short = settle(asked.join(enough, "query_id", "left_anti"))
    if not short.isEmpty():
        found = found.union(candidates(distinct, short, tables, 1.0, keep, block)).groupBy("query_id", "gid").agg(F.max("near").alias("near"))
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "gid")
    merged = found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= keep).select("query_id", "gid")
    measured = merged.join(distinct, "gid").join(asked.withColumnRenamed("v", "q"), "query_id")
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = measured.select("query_id", score.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
