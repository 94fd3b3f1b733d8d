"""Exact order statistics that never put one key's rows into one task.

Two forms. ``quantiles`` narrows each wanted rank of long keys down by histograms, so that only the few
values around a rank are ever shuffled. ``running`` gives cumulative sums over all distinct values of a key:
rows are laid out in value ranges, each range sums for itself, and the totals of earlier ranges are added.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltacell.operators.joins import attach
from deltacell.session import settle

TASK_ROWS = 1_000_000
#: Classes of the first histogram between a number and its double, and parts of a bracket per further round.
OCTAVE, FAN = 32, 1024


def _class(v: Column, octave: int) -> Column:
    """Number of a value's class: never falls as the value grows, whatever its size or sign.

    A class spans a fixed ratio of values, so there are at most 4300 x ``octave`` of them. Zero, the
    infinities and NaN (the largest, as in a sort) have their own.
    """
    size = F.abs(v)
    end = 2200 * octave
    finite = F.floor((F.log2(size) + 1080) * octave).cast("int") + 1
    ranked = F.when(size == 0, 0).when(size == float("inf"), end).otherwise(finite)
    return F.when(F.isnan(v), end + 1).when(v < 0, -ranked).otherwise(ranked)


def quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
    task_rows: int = TASK_ROWS, octave: int = OCTAVE, fan: int = FAN,
) -> DataFrame:
    """Exact interpolated quantiles per key: columns ``keys``, ``n`` and one per name in ``probs``.

    Where no key has more than ``task_rows`` values, the built-in ``percentile`` does it without a written
    table. Else a scan counts values by class and keeps each class's smallest and largest value. A wanted
    rank lies in one class, a bracket; brackets of a single value are done. The next scan takes the
    values inside the others, ranked exactly. A bracket of more than ``task_rows`` values is first cut
    in ``fan`` parts by a scan of its own; a bracket of doubles can be cut six times at most. NULL is
    left out, NaN is the largest value; a key without a value has no row.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    longest, rows_left = data.groupBy(*keys).agg(F.count("_v").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if longest is None or longest <= task_rows:
        ps = F.array(*[F.lit(float(p)) for p in probs.values()])
        short = data.groupBy(*keys).agg(F.count("_v").alias("n"), F.percentile("_v", ps).alias("_q"))
        return short.select(*keys, "n", *[F.get("_q", F.lit(i)).alias(m) for i, m in enumerate(probs)])
    counted = data.groupBy(*keys, _class(F.col("_v"), octave).alias("_slot")).agg(*_counted())
    every = counted.select("*", F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"), F.lit(0).cast("bigint").alias("_base"))
    found = settle(_per_key(_holding(every, keys, probs), keys))
    size = lambda b: b["_to"] - b["_from"]
    sizes = F.transform(F.filter("_b", lambda b: b["_lo"] < b["_hi"]), size)
    total = F.sum(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x))
    while True:
        most, held = found.agg(F.max(F.array_max(sizes)), total).first()
        if most is None:
            break
        if held * 4 <= rows_left:
            # Later rounds look only inside these brackets, so they need not scan all values again.
            open_ = lambda b: b["_lo"] < b["_hi"]
            data, rows_left = settle(_inside(data, found, keys, 2 * len(probs), open_).select(*keys, "_v")), held
        if most <= task_rows:
            break
        long = lambda b: (b["_lo"] < b["_hi"]) & (size(b) > task_rows)
        parts = _holding(_narrow(data, found, keys, 2 * len(probs), long, fan), keys, probs)
        found = settle(_per_key(_listed(found, keys, lambda b: ~long(b)).unionByName(parts), keys))
    points = _listed(found, keys, lambda b: b["_lo"] == b["_hi"])
    if most is not None:
        wide = lambda b: b["_lo"] < b["_hi"]
        points = points.unionByName(_holding(_narrow(data, found, keys, 2 * len(probs), wide), keys, probs))
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("_lo")))
    ends = [at(r).alias(f"_{i}_{k}") for i, p in enumerate(probs.values()) for k, r in enumerate(_ranks(p))]
    rows = points.groupBy(*keys).agg(F.max("_n").alias("n"), *ends)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        lo, hi, pos = F.col(f"_{i}_0"), F.col(f"_{i}_1"), F.lit(float(p)) * (F.col("n") - 1)
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return rows.select(*keys, "n", *out)


_BRACKET = ("_from", "_to", "_lo", "_hi")


def _counted() -> tuple[Column, ...]:
    return F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")


def _ranks(p: float) -> tuple[Column, Column]:
    pos = F.lit(float(p)) * (F.col("_n") - 1)
    return F.floor(pos), F.ceil(pos)


def _holding(parts: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """The parts, in order of ``_slot``, that hold a wanted rank, with the ranks ``_from`` to ``_to`` they cover."""
    w = Window.partitionBy(*keys, "_base").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.select(*keys, "_n", "_c", "_lo", "_hi", (F.col("_base") + F.sum("_c").over(w)).alias("_to"))
    start = F.col("_to") - F.col("_c")
    held = [(start <= r) & (r < F.col("_to")) for p in probs.values() for r in _ranks(p)]
    return placed.where(reduce(Column.__or__, held)).select(*keys, "_n", start.alias("_from"), "_to", "_lo", "_hi")


def _per_key(brackets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its brackets, of which there are at most two a wanted quantile."""
    return brackets.groupBy(*keys).agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct(*_BRACKET))).alias("_b"))


def _listed(found: DataFrame, keys: list[str], kept: Callable[[Column], Column]) -> DataFrame:
    return found.select(*keys, "_n", F.inline(F.filter("_b", kept)))


def _inside(data: DataFrame, found: DataFrame, keys: list[str], most: int, taken: Callable[[Column], Column]) -> DataFrame:
    """Rows of ``data`` that lie in a taken bracket, with it as ``_in``."""
    v, at = F.col("_v"), [F.get("_b", F.lit(i)) for i in range(most)]
    rows = attach(data, found, keys, "inner")
    which = F.coalesce(*[F.when(taken(b) & v.between(b["_lo"], b["_hi"]), b) for b in at])
    return rows.select(*keys, "_n", "_v", which.alias("_in")).where(F.col("_in").isNotNull())


def _narrow(
    data: DataFrame, found: DataFrame, keys: list[str], most: int, taken: Callable[[Column], Column], fan: int | None = None
) -> DataFrame:
    """Counts of ``data`` inside the taken brackets, by part of the bracket or, without ``fan``, by value."""
    v, rows = F.col("_v"), _inside(data, found, keys, most, taken)
    slot, lo, hi = v, F.col("_in._lo"), F.col("_in._hi")
    if fan is not None:
        slot = F.least(F.lit(fan - 1), F.floor((v - lo) / (hi - lo) * fan).cast("int"))
    return rows.groupBy(*keys, "_n", F.col("_in._from").alias("_base"), slot.alias("_slot")).agg(*_counted())


def running(distinct: DataFrame, keys: list[str], value: str, sums: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Add ``<c>_before`` and ``<c>_all`` for each column in ``sums``, per key in order of ``value``.

    ``distinct`` holds one row per key and value. More than ``task_rows`` rows are laid out in ranges
    of keys and values, whose bounds Spark samples, so a long key spans several ranges and an outlier
    costs nothing. Ranges sum for themselves. Only keys that span ranges need the totals of others:
    at most two rows a range, which are broadcast.
    """
    table = settle(distinct)
    parts = -(-table.count() // task_rows)
    if parts > 1:
        table = settle(table.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()))
    else:
        table = table.withColumn("_part", F.lit(0))
    own = Window.partitionBy(*keys, "_part")
    before = own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = table
    for c in sums:
        out = out.withColumn(f"{c}_before", F.sum(c).over(before) - F.col(c)).withColumn(f"{c}_all", F.sum(c).over(own))
    if parts <= 1:
        return out.drop("_part")
    totals = table.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    key = Window.partitionBy(*keys)
    earlier = key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.withColumn("_spans", F.count(F.lit(1)).over(key))
    for c in sums:
        spans = spans.withColumn(f"_o_{c}", F.sum(f"_t_{c}").over(earlier)).withColumn(f"_a_{c}", F.sum(f"_t_{c}").over(key))
    spans = spans.where("_spans > 1").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"),
        *[f"_{o}_{c}" for c in sums for o in "oa"],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_part") == F.col("_k_part")]
    out = out.join(F.broadcast(spans), reduce(Column.__and__, same), "left")
    for c in sums:
        out = out.withColumn(f"{c}_before", F.col(f"{c}_before") + F.coalesce(f"_o_{c}", F.lit(0)))
        out = out.withColumn(f"{c}_all", F.coalesce(f"_a_{c}", f"{c}_all"))
    return out.select(*distinct.columns, *[f"{c}_{s}" for c in sums for s in ("before", "all")])


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rank with the mean rank for ties, one row per key and distinct value."""
    return _tie_counts(df, keys, value, task_rows).select(
        *keys, value, (F.col("_c_before") + (F.col("_c") + 1) / 2).alias(out)
    )


def _tie_counts(df: DataFrame, keys: list[str], value: str, task_rows: int) -> DataFrame:
    known = df.where(F.col(value).isNotNull())
    distinct = known.groupBy(*keys, value).agg((F.sum("_c") if "_c" in df.columns else F.count(F.lit(1))).alias("_c"))
    return running(distinct, keys, value, ["_c"], task_rows)


def spearman(df: DataFrame, keys: list[str], x: str, y: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rank correlation of two columns per key, over rows where both are known; NULL where a column is constant.

    Equal pairs count once from the start. Ranks are kept as distances from their mean, which is half
    the count for any ties, so sums need no second pass and lose no digits. Both rank tables have one
    row per value; a value that many pairs share is split by the adaptive skew join.
    """
    pairs = settle(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_c"))
    )
    out = pairs
    for side, name in ((x, "_dx"), (y, "_dy")):
        off = (2 * F.col("_c_before") + F.col("_c") - F.col("_c_all")) / 2
        out = out.join(_tie_counts(pairs, keys, side, task_rows).select(*keys, side, off.alias(name)), [*keys, side])
    total = lambda a, b: F.sum(F.col("_c") * F.col(a) * F.col(b))
    spread = F.sqrt(total("_dx", "_dx")) * F.sqrt(total("_dy", "_dy"))
    return out.groupBy(*keys).agg(F.sum("_c").alias("n"), F.try_divide(total("_dx", "_dy"), F.nullif(spread, F.lit(0.0))).alias("rho"))
