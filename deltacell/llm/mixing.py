"""Temperature mixing: sources weighed by a power of their token shares, drawn in permuted blocks.

A source with share ``p`` gets weight ``p ** a / sum(p ** a)``. The exponent ``a`` is the largest in
[0, 1] whose weights reach a target entropy, raised if a source would otherwise repeat more often
than allowed. Both are found by cutting the interval into sixteenths, one aggregate over the source
table a round.

A source's documents lie in blocks chosen by hash. Each epoch of a source orders its blocks anew and
takes them until the source's token budget is spent, so only block totals are summed in order; the
one block in which the budget ends is cut between documents. All of it is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltacell.session import settle

CUTS, ROUNDS = 16, 8


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(shares: DataFrame, entropy: float, repeats: float, budget: float) -> float:
    """Largest exponent that reaches ``entropy`` (as a share of the largest), raised to keep the
    rarest source within ``repeats`` epochs. ``shares`` has one row per source with its share ``p``;
    ``budget`` is in units of all tokens."""
    def measures(points):
        e = F.explode(F.array(*[F.lit(x) for x in points]))
        powers = shares.select("p", e.alias("e")).groupBy("e").agg(
            F.sum(F.pow("p", "e")).alias("z"), F.sum(F.pow("p", "e") * F.log("p")).alias("s"),
            F.min("p").alias("least"), F.count(F.lit(1)).alias("k"))
        return {r["e"]: r for r in powers.collect()}

    def search(meets, keep_low):
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            points = [low + (high - low) * k / CUTS for k in range(CUTS + 1)]
            found = measures(points)
            good = [meets(found[x], x) for x in points]
            if keep_low:
                k = max((i for i, g in enumerate(good) if g), default=0)
                low, high = points[k], points[min(k + 1, CUTS)]
            else:
                k = min((i for i, g in enumerate(good) if g), default=CUTS)
                low, high = points[max(k - 1, 0)], points[k]
            if low == high:
                break
        return low if keep_low else high

    if shares.isEmpty():
        return 1.0
    flat = search(lambda r, e: math.log(r["z"]) - e * r["s"] / r["z"] >= entropy * math.log(r["k"]) - 1e-12, True)
    safe = search(lambda r, e: budget * r["least"] ** (e - 1) / r["z"] <= repeats + 1e-12, False)
    return round(max(flat, safe), 6)


def plan(docs: DataFrame, entropy: float, repeats: float, budget: float, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their source key, tokens and block; and the draws of each block.

    Draws: (_key, _block, _draws), an array of (epoch, start, room): ``start`` is the block's first
    token in its source's order, ``room`` what the source's budget leaves for it.
    """
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_key"),
        word_count(F.col("text").cast("string")).alias("_tokens"), hashed.alias("_order"),
    ).withColumn("_block", F.expr(f"cast(conv(substr(_order, 1, 6), 16, 10) as int) % {blocks}"))
    sums = settle(rows.groupBy("_key", "_block").agg(F.sum("_tokens").alias("_sum")))
    per = sums.groupBy("_key").agg(F.sum("_sum").alias("_n")).where("_n > 0")
    total = per.agg(F.sum("_n")).first()[0] or 0
    shares = settle(per.withColumn("p", F.col("_n") / F.lit(float(total or 1))))
    a = exponent(shares, entropy, repeats, budget)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    spent = F.floor(F.round(F.pow("p", F.lit(a)) / F.lit(z), 9) * F.lit(float(math.floor(budget * total)))).cast("long")
    goals = shares.select("_key", "_n", spent.alias("_goal"), F.floor(spent / F.col("_n")).cast("int").alias("_full"))
    turns = sums.join(goals, "_key").withColumn("epoch", F.explode(F.expr("sequence(0, _full)")))
    turn = F.md5(F.concat_ws(":", "_key", "epoch", "_block").cast("binary"))
    order = Window.partitionBy("_key", "epoch").orderBy(turn, "_block").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_before", F.coalesce(F.sum("_sum").over(order), F.lit(0)))
    turns = turns.withColumn("start", F.col("epoch") * F.col("_n") + F.col("_before")).where("start < _goal or (epoch < _full and _sum = 0)")
    draws = turns.groupBy("_key", "_block").agg(
        F.collect_list(F.struct("epoch", "start", (F.col("_goal") - F.col("start")).alias("room"), F.col("_sum").alias("size"))).alias("_draws")
    )
    return rows, draws


def mix(
    docs: DataFrame, entropy: float = 0.9, repeats: float = 4.0, budget: float = 1.0, blocks: int = 1024, tracked: bool = False
) -> DataFrame:
    """Rows of ``docs``, each as often as it is drawn; with ``tracked`` also _key, _tokens, epoch, _block, start.

    ``docs`` needs doc_id, text and source. The budget is ``budget`` times all words; every source
    gets its weight's part of it, to within the last document. A null source counts as the empty
    one. A null or empty text has no words: it comes with its block. A source without any word is
    not drawn. Repeated rows are drawn each. An empty table gives an empty table. Other columns may
    have any name, as they are numbered on their way; only those of ``tracked`` must be free.
    """
    given = docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(f"_given{k}") for k, c in enumerate(docs.columns)])
    rows, draws = plan(given, entropy, repeats, budget, blocks)
    drawn = rows.join(draws, ["_key", "_block"]).withColumn("_d", F.explode("_draws"))
    names = [F.col(f"_given{k}").alias(c) for k, c in enumerate(docs.columns)]
    more = ["_key", "_tokens", F.col("_d.epoch").alias("epoch"), "_block", F.col("_d.start").alias("start")] if tracked else []
    whole = drawn.where("_d.size <= _d.room").select(*names, *more)
    within = Window.partitionBy("_key", "_block", "_d.epoch").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    part = drawn.where("_d.size > _d.room").withColumn("_run", F.sum("_tokens").over(within)).where("_run <= _d.room")
    return whole.union(part.select(*names, *more))


#: The same draws in DuckDB SQL, for the default parameters.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens,
         md5(coalesce(doc_id::VARCHAR, '')) AS o, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6))::INT % 1024 AS block
  FROM documents
), sums AS (SELECT source, block, sum(n_tokens)::BIGINT AS s FROM d GROUP BY ALL),
per AS (SELECT source, sum(s)::BIGINT AS n FROM sums GROUP BY source HAVING sum(s) > 0),
shares AS (SELECT source, n, n / (SELECT sum(n) FROM per)::DOUBLE AS p FROM per),
ps AS (SELECT list(p) AS v, count(*) AS k, min(p) AS least FROM shares),
bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
  UNION ALL
  SELECT i + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END,
         CASE WHEN safe THEN rlo ELSE rmid END, CASE WHEN safe THEN rmid ELSE rhi END
  FROM (
    SELECT i, lo, hi, rlo, rhi, (lo + hi) / 2 AS mid, (rlo + rhi) / 2 AS rmid,
      ln(list_sum([pow(x, (lo + hi) / 2) for x in v])) - (lo + hi) / 2 * list_sum([pow(x, (lo + hi) / 2) * ln(x) for x in v])
        / list_sum([pow(x, (lo + hi) / 2) for x in v]) >= 0.9 * ln(k) - 1e-12 AS flat,
      pow(least, (rlo + rhi) / 2 - 1) / list_sum([pow(x, (rlo + rhi) / 2) for x in v]) <= 4 + 1e-12 AS safe
    FROM bisect, ps WHERE i < 40)
), ends AS (
  SELECT CASE WHEN hi = 1 THEN 1 ELSE lo END AS lo, CASE WHEN rlo = 0 THEN 0 ELSE rhi END AS rhi FROM bisect WHERE i = 40
), a AS (SELECT round(greatest(lo, rhi), 6) AS a FROM ends),
w AS (SELECT source, n, floor(round(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, a), 9) * (SELECT sum(n) FROM per)::DOUBLE)::BIGINT AS goal FROM shares, a),
turns AS (SELECT source, block, s, n, goal, goal // n AS f, unnest(range(goal // n + 1)) AS epoch FROM sums JOIN w USING (source)),
t AS (
  SELECT *, epoch * n + coalesce(sum(s) OVER (PARTITION BY source, epoch ORDER BY md5(source || ':' || epoch || ':' || block), block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM turns
), j AS (
  SELECT d.*, t.epoch, t.start, t.s > t.goal - t.start AS cut, t.goal - t.start AS room,
    sum(n_tokens) OVER (PARTITION BY source, block, epoch ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM d JOIN t USING (source, block) WHERE t.start < t.goal OR (t.epoch < t.f AND t.s = 0)
)
SELECT doc_id, source, n_tokens, epoch::INT AS epoch, block::INT AS block, start FROM j WHERE NOT cut OR run <= room
"""


def draws(docs: DataFrame, **options) -> DataFrame:
    """One row per draw: doc_id, source, n_tokens, epoch, block, start (the block's first token in its source's order)."""
    drawn = mix(docs.select("doc_id", "text", "source"), tracked=True, **options)
    return drawn.select("doc_id", F.col("_key").alias("source"), F.col("_tokens").alias("n_tokens"), "epoch",
                        F.col("_block").alias("block"), "start")
