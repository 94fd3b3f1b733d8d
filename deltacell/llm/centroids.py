"""Exact k-means over integer vectors, in rounds that scan only the vectors that may have moved.

Each vector keeps its cluster and a lower bound on its distance to every other centroid. When a
centroid moves, its bounds must be loosened. The usual amount is its drift; here each cluster is a sphere around its old centroid, and in the plane through a moved centroid's
two places and the sphere's middle the loss is bounded by geometry: the points that come nearer by
more than ``drift * cos(t)`` lie in the cone of half angle ``t`` around the movement, seen from the
point half-way. A sphere beside or behind the movement so loses less, or nothing. A vector whose
distance to its own centroid stays below its other bounds keeps its cluster; every other one is scanned
against all centroids in exact integer arithmetic, so results are those of the plain algorithm.

Vectors are written once, in blocks of ``BLOCK``, into buckets by block; bounds are written per round
into the same buckets. The two meet bucket by bucket without a shuffle, so vectors never move again.
Sums change only by the vectors that moved.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltacell.session import scratch_root, settle

BLOCK = 128
#: Integer components must stay below this, as squared distances of 64 of them must fit 63 bits.
LIMIT = 1 << 27
#: Below this the arithmetic of doubles is exact, and used because it is faster.
EXACT = 1 << 21
BUCKET_BYTES = 64 * 1024 * 1024
#: Relative room for rounding in bounds; a wrong side of it only costs a scan.
ROOM = 1e-9

_BLOCKS = "block long, n int, ids binary, named binary, parts binary"
_STATE = "block long, cluster binary, bound binary, moved binary, shift binary, radius binary, scanned int"
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept(vector: Column, size: int) -> Column:
    """Exactly ``size`` components, none null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vector.isNotNull() & (F.size(vector) == size) & sound


def _matrix(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept, and their integer components."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64()).fill_null(math.nan)
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
    sound = np.isfinite(values).all(axis=1)
    whole = np.floor(values[sound] * scale)
    if whole.size and np.abs(whole).max() >= LIMIT:
        raise ValueError(f"a component times {scale} is {LIMIT} or more: squared distances would not fit 63 bits")
    return rows[sound], whole.astype(np.int32)


def _to_blocks(size: int, scale: int):
    def run(batches):
        block = TaskContext.get().partitionId() << 33

        def row(ids, parts):
            named = np.array([i is not None for i in ids], np.uint8)
            numbers = np.array([i or 0 for i in ids], "<i8")
            return [block, len(ids), numbers.tobytes(), named.tobytes(), parts.astype("<i4").tobytes()]

        ids, parts = [], np.zeros((0, size), np.int32)
        for batch in batches:
            rows, whole = _matrix(batch.column(1), size, scale)
            ids += batch.column(0).take(pa.array(rows)).to_pylist()
            parts = np.concatenate([parts, whole])
            full = len(ids) // BLOCK * BLOCK
            out = []
            for at in range(0, full, BLOCK):
                out.append(row(ids[at:at + BLOCK], parts[at:at + BLOCK]))
                block += 1
            ids, parts = ids[full:], parts[full:]
            if out:
                yield _batch(out)
        if ids:
            yield _batch([row(ids, parts)])

    def _batch(rows):
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = ["block", "n", "ids", "named", "parts"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    return run


def _bucketed(df: DataFrame, buckets: int) -> str:
    """Write into buckets by block in the shared folder; the name of the table."""
    spark = df.sparkSession
    name = f"deltacell_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").sortBy("block").option("path", f"{scratch_root(spark)}/{name}").saveAsTable(name)
    return name


def squares(parts: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if not parts.size:
        return np.zeros((len(parts), len(centroids)), np.int64)
    if max(np.abs(parts).max(), np.abs(centroids).max()) < EXACT:
        p, c = parts.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2.0 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    p = parts.astype(np.int64)
    return np.stack([((p - c) ** 2).sum(1) for c in centroids.astype(np.int64)], axis=1)


def own_squares(parts: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its own centroid."""
    return ((parts.astype(np.int64) - centroids[cluster]) ** 2).sum(1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much any vector of a cluster (row) may have come nearer to a centroid (column).

    ``radius`` bounds the distances of a cluster's vectors to its old centroid. Never more than the
    centroid's drift, and never negative. The diagonal is infinite, as own distances are computed.
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    out = np.zeros((len(old), len(old)))
    for j in range(len(old)):
        move = new[j] - old[j]
        drift = math.sqrt(float(move @ move))
        if not drift:
            continue
        away = old - (old[j] + new[j]) / 2
        far = np.sqrt((away * away).sum(1))
        for i in range(len(old)):
            share = 1.0
            if radius[i] < far[i]:
                cone = math.acos(max(-1.0, min(1.0, float(away[i] @ move) / (far[i] * drift)))) - math.asin(radius[i] / far[i])
                share = 1.0 if cone <= 0 else max(0.0, math.cos(cone))
            out[i, j] = drift * min(1.0, share + ROOM)
    np.fill_diagonal(out, math.inf)
    return out


def _below(bounds: np.ndarray) -> np.ndarray:
    """As 32-bit floats, rounded down."""
    return np.nextafter(bounds.astype("<f4"), np.float32(-math.inf))


def _step(size: int, centroids: np.ndarray, loosen: np.ndarray):
    """Arrow function over blocks and their bounds (null at first) to the new bounds."""

    def block(parts, cluster, bound):
        n, k = len(parts), len(centroids)
        if cluster is None:
            before, scan, bound = np.full(n, -1, np.int32), np.ones(n, bool), np.zeros((n, k), np.float32)
            cluster, squared = np.zeros(n, np.int32), np.zeros(n, np.int64)
        else:
            before = cluster
            cluster, bound = cluster.copy(), _below(bound.reshape(n, k) - loosen[cluster])
            squared = own_squares(parts, centroids, cluster)
            others = bound.copy()
            others[np.arange(n), cluster] = math.inf
            scan = ~(np.sqrt(squared) * (1 + ROOM) < others.min(1).astype(np.float64) * (1 - ROOM))
        if scan.any():
            every = squares(parts[scan], centroids)
            near = every.argmin(1)  # the first of equals
            cluster[scan], squared[scan] = near, every[np.arange(len(near)), near]
            bound[scan] = _below(np.sqrt(every) * (1 - ROOM))
        changed = np.flatnonzero(cluster != before)
        shift = np.zeros((k, size + 1), np.int64)
        if len(changed):
            rows = np.concatenate([parts[changed].astype(np.int64), np.ones((len(changed), 1), np.int64)], axis=1)
            np.add.at(shift, cluster[changed], rows)
            left = before[changed] >= 0
            np.subtract.at(shift, before[changed][left], rows[left])
        moved = np.flatnonzero(shift.any(axis=1)).astype("<i4")
        radius = np.zeros(k)
        np.maximum.at(radius, cluster, np.sqrt(squared) * (1 + ROOM))
        return [
            cluster.astype("<i4").tobytes(), bound.astype("<f4").tobytes(), moved.tobytes(), shift[moved].astype("<i8").tobytes(),
            radius.astype("<f8").tobytes(), int(scan.sum()),
        ]

    def run(batches):
        types = [pa.int64(), *[pa.binary()] * 5, pa.int32()]
        names = ["block", "cluster", "bound", "moved", "shift", "radius", "scanned"]
        for batch in batches:
            out = []
            for b, parts, c, t in zip(*[batch.column(n).to_pylist() for n in ("block", "parts", "cluster", "bound")], strict=True):
                cluster = None if c is None else np.frombuffer(c, "<i4")
                out.append([b, *block(np.frombuffer(parts, "<i4").reshape(-1, size), cluster, None if t is None else np.frombuffer(t, "<f4"))])
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)], names=names)

    return run


def _sums(size: int, k: int):
    """Arrow function over bounds: per task, the change of every sum and count, and each cluster's radius."""

    def run(batches):
        total, radius, seen = np.zeros((k, size + 1), object), np.zeros(k), False
        for batch in batches:
            part = np.zeros((k, size + 1), np.int64)  # a block adds less than 2^35
            for moved, shift, r in zip(*[batch.column(n).to_pylist() for n in ("moved", "shift", "radius")], strict=True):
                seen = True
                at = np.frombuffer(moved, "<i4")
                part[at] += np.frombuffer(shift, "<i8").reshape(len(at), size + 1)
                radius = np.maximum(radius, np.frombuffer(r, "<f8"))
            total += part
        if seen:
            where = np.indices(total.shape).reshape(2, -1).astype(np.int32)
            wide = np.repeat(radius, size + 1)
            yield pa.record_batch(
                [pa.array(where[0]), pa.array(where[1]), pa.array([str(x) for x in total.ravel()]), pa.array(wide)],
                names=["cluster", "place", "total", "radius"],
            )

    return run


def _members(size: int, centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            for ids, named, parts, c in zip(*[batch.column(n).to_pylist() for n in ("ids", "named", "parts", "cluster")], strict=True):
                cluster = np.frombuffer(c, "<i4")
                squared = own_squares(np.frombuffer(parts, "<i4").reshape(-1, size), centroids, cluster)
                known = np.frombuffer(named, np.uint8) == 0
                yield pa.record_batch(
                    [pa.array(np.frombuffer(ids, "<i8"), mask=known), pa.array(cluster), pa.array(squared)],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


def first_centroids(vectors: DataFrame, k: int, prefix: str, size: int, scale: int, id_column: str, column: str) -> np.ndarray:
    """Integer components of the ``k`` kept vectors of smallest hash, ties by components; k rows on the driver."""
    whole = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale))
    ranked = vectors.where(kept(F.col(column), size)).select(
        F.sha2(F.concat(F.lit(prefix), F.col(id_column).cast("string")), 256).alias("h"), whole.alias("parts")
    )
    rows = ranked.orderBy(F.col("h").asc_nulls_last(), "parts").limit(k).collect()
    return np.array([r.parts for r in rows], np.int64).reshape(-1, size)


class Run:
    """Blocks, bounds and centroids of one clustering; ``scanned`` holds the rows scanned per round."""

    def __init__(self, vectors: DataFrame, k: int, prefix: str, size: int, scale: int, id_column: str, column: str):
        self.spark: SparkSession = vectors.sparkSession
        self.size = size
        self.scanned: list[int] = []
        own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector"))
        self.rows = own.count()
        least = 2 * self.spark.sparkContext.defaultParallelism
        self.buckets = max(least, -(-self.rows * size * 4 // BUCKET_BYTES))
        made = own.mapInArrow(_to_blocks(size, scale), _BLOCKS).repartition(self.buckets, "block")
        self.blocks = _bucketed(made, self.buckets)
        self.centroids = first_centroids(vectors, k, prefix, size, scale, id_column, column)
        self.totals = [[0] * (size + 1) for _ in self.centroids]
        self.loosen = np.zeros((len(self.centroids), len(self.centroids)))
        self.bounds: str | None = None

    def assign(self) -> None:
        """Assign every vector to its nearest centroid."""
        rows = self.spark.table(self.blocks)
        if self.bounds is None:
            met = rows.select("block", "parts", F.lit(None).cast("binary").alias("cluster"), F.lit(None).cast("binary").alias("bound"))
        else:
            state = self.spark.table(self.bounds).select("block", "cluster", "bound")
            met = rows.select("block", "parts").join(state.hint("merge"), "block")
        self.drop(self.bounds)
        self.bounds = _bucketed(met.mapInArrow(_step(self.size, self.centroids, self.loosen), _STATE), self.buckets)
        self.scanned.append(self.spark.table(self.bounds).agg(F.sum("scanned")).first()[0] or 0)

    def update(self) -> None:
        """Move every non-empty centroid to its vectors' floored mean, and bound what that does to others."""
        k = len(self.centroids)
        state = self.spark.table(self.bounds).select("moved", "shift", "radius")
        change = state.mapInArrow(_sums(self.size, k), "cluster int, place int, total string, radius double")
        sums = change.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t"), F.max("radius").alias("r"))
        radius = np.zeros(k)
        for r in sums.collect():  # k * (size + 1) rows at any size of the table
            self.totals[r.cluster][r.place] += int(r.t)
            radius[r.cluster] = max(radius[r.cluster], r.r)
        new = self.centroids.copy()
        for j, t in enumerate(self.totals):
            if t[-1]:
                new[j] = [x // t[-1] for x in t[:-1]]
        self.loosen = loosening(self.centroids, new, radius)
        self.centroids = new

    def members(self) -> DataFrame:
        met = self.spark.table(self.blocks).join(self.spark.table(self.bounds).select("block", "cluster").hint("merge"), "block")
        return met.mapInArrow(_members(self.size, self.centroids), "vec_id long, cluster int, distance long")

    def drop(self, name: str | None) -> None:
        """Forget a table's name; its files stay until the shared folder is cleared."""
        if name:
            self.spark.sql(f"DROP TABLE {name}")


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, prefix: str = "3:", size: int = 64, scale: int = 1024,
    id_column: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """k-means of integer vectors ``floor(scale * x)``: one row per kept vector, as in :data:`_RESULT`.

    Kept are vectors of exactly ``size`` components, none null or not finite. The first centroids are
    the ``k`` kept vectors with the smallest hex sha256 of ``prefix`` and the id (all, if fewer). Ties
    in distance go to the smaller cluster. Rows that repeat are vectors of their own; rows with the
    same hash start in the order of their components. A null id is carried along, and its vector is
    a first centroid only where ids are too few. No kept vector gives no row. Components of 2^17 or
    more (after scaling, 2^27) raise, as squared distances would not fit a long. Other columns are
    not looked at.
    """
    spark = vectors.sparkSession
    run = Run(vectors, k, prefix, size, scale, id_column, column)
    if not len(run.centroids):
        return spark.createDataFrame([], _RESULT)
    for _ in range(rounds):
        run.assign()
        run.update()
    run.assign()
    rows = settle(run.members())
    for name in (run.blocks, run.bounds):
        run.drop(name)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in run.centroids]
    named = F.create_map(*[x for j, d in enumerate(digest) for x in (F.lit(j), F.lit(d))])
    own = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia"))
    all_of = rows.agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long")).first()[0]
    own = own.select("cluster", "cluster_inertia", F.lit(all_of).cast("long").alias("inertia"), named[F.col("cluster")].alias("centroid_sha256"))
    return rows.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 8, rounds: int = 10, prefix: str = "3:") -> str:
    """The plain algorithm, round by round, as DuckDB SQL over ``embeddings``."""
    ctes = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{prefix}' || vec_id)) - 1 AS cluster, x AS c
  FROM (SELECT * FROM v ORDER BY sha256('{prefix}' || vec_id) LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (
  SELECT n, any_value(vec_id) AS vec_id, any_value(x) AS x, min((d::HUGEINT * 1024 + cluster)) AS best FROM (
    SELECT n, vec_id, x, cluster, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
    FROM v, c{r}) GROUP BY n)"""
        )
        if r < rounds:
            ctes.append(
                f"""m{r} AS MATERIALIZED (
  SELECT cluster, list(floor_mean ORDER BY i) AS c FROM (
    SELECT cluster, i, ((s - ((s % q) + q) % q) // q)::BIGINT AS floor_mean FROM (
      SELECT (best % 1024)::INTEGER AS cluster, i, sum(x[i]) AS s, count(*)::HUGEINT AS q
      FROM a{r}, range(1, 65) AS p(i) GROUP BY ALL)) GROUP BY cluster)"""
            )
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))")
    return f"""WITH {', '.join(ctes)},
z AS (SELECT vec_id, (best % 1024)::INTEGER AS cluster, (best // 1024)::BIGINT AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM z JOIN c{rounds} USING (cluster)"""
