"""How document filters interact: what each removes in every order they could be applied in.

A document is reduced to the letters of the filters it fails. Counts per part and set of letters add
up, and every order's figures follow from them, so documents are read for the letters once however
many orders are asked for.

The filter on repeated texts needs all documents. A counting Bloom sketch of text hashes comes first:
its cells are counted per task and merged by an aggregate, and a text with a cell of its own is
certainly unique. Only the others, the possible repeats, are shuffled with their whole texts, to the
smallest doc_id of each. The sketch grows with the number of rows (16 cells a row in pages of 4096,
a text's three cells in one page); its pages are broadcast after a count, beyond ``PAGES`` they are
joined with salted keys.
"""

from __future__ import annotations

from itertools import permutations
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltacell.operators.joins import salted_join
from deltacell.session import settle

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
CELLS_A_ROW = 16
PAGE_BITS = 12
#: Pages sent to every executor: 64 longs each, so at most some 40 MB.
PAGES = 65_536
#: Rows of ids, digests or labels sent to every executor.
FEW = 400_000

_WORD_GAP = r"[\x20\x09-\x0D]+"


def _meet(df: DataFrame, lookup: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Left join with a written one-row-per-key table, broadcast up to ``most`` rows, else by salted keys."""
    return df.join(F.broadcast(lookup), keys, "left") if lookup.count() <= most else salted_join(df, lookup, keys)


def failed_letters(text: Column) -> Column:
    """Letters of A to D that a text fails, in order; see :func:`audit` for the rules."""
    words = F.filter(F.split(text, _WORD_GAP), lambda w: w != "")
    few = F.size(words) < 200
    same = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    loud = 100 * (F.length(text) - F.length(F.translate(text, ascii_uppercase, ""))) > 3 * F.length(text)
    marks = text.rlike(r"[#$%&*|]")
    return F.concat(*[F.when(c, F.lit(x)).otherwise(F.lit("")) for x, c in zip("ABCD", (few, same, loud, marks), strict=True)])


def _cells(digest: Column, pages: int) -> tuple[Column, list[Column]]:
    page = F.shiftrightunsigned(digest, 36).bitwiseAND(F.lit(pages - 1).cast("long"))
    return page, [F.shiftrightunsigned(digest, PAGE_BITS * i).bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).cast("int") for i in range(3)]


def shared_cells(hashes: DataFrame, pages: int) -> DataFrame:
    """Pages of the merged sketch as (``page``, ``bits``): one bit per cell that two rows or more fell into.

    ``hashes`` has one long column ``hash``. Equal hashes are counted within a task before they move,
    so a text that a third of all rows hold is a few counters.
    """
    page, cells = _cells(F.col("hash"), pages)
    fallen = hashes.select(page.alias("page"), F.explode(F.array_distinct(F.array(*cells))).alias("cell"))
    shared = fallen.groupBy("page", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    packed = shared.groupBy("page", F.shiftright("cell", 6).alias("slot")).agg(
        F.expr("bit_or(shiftleft(1L, cell & 63))").alias("bits")
    )
    by_slot = packed.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias("m"))
    slots = F.sequence(F.lit(0), F.lit((1 << PAGE_BITS - 6) - 1))
    return by_slot.select("page", F.transform(slots, lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("bits"))


def _possible(df: DataFrame, pages: int, sketch: DataFrame) -> DataFrame:
    """Adds ``possible``: whether all cells of ``hash`` are shared. False is certain."""
    page, cells = _cells(F.col("hash"), pages)
    met = _meet(df.withColumn("page", page), sketch, ["page"], PAGES)
    bit = lambda c: F.getbit(F.get("bits", F.shiftright(c, 6)), c.bitwiseAND(F.lit(63))) == 1
    every = bit(cells[0]) & bit(cells[1]) & bit(cells[2])
    return met.withColumn("possible", F.coalesce(every, F.lit(False))).drop("page", "bits")


def flags(docs: DataFrame, cells_a_row: int = CELLS_A_ROW) -> DataFrame:
    """One row per document: ``doc_id``, ``part``, ``fails`` (letters of failed filters, in order) and ``possible``.

    Rules and cases as in :func:`audit`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("text"), F.xxhash64(text).alias("hash"),
    )
    pages = 1
    while pages << PAGE_BITS < cells_a_row * docs.count():
        pages *= 2
    sketch = settle(shared_cells(rows.select("hash"), pages))
    letters = rows.select("doc_id", "part", "hash", failed_letters(F.col("text")).alias("fails"), F.sha2("text", 256).alias("digest"))
    narrow = settle(
        _possible(letters, pages, sketch)
        .select("doc_id", "part", "fails", "possible", F.when(F.col("possible"), F.col("digest")).alias("digest"))
    )
    repeats = _possible(rows.where("doc_id is not null").select("doc_id", "text", "hash"), pages, sketch).where("possible")
    firsts = repeats.groupBy("text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    firsts = settle(firsts.select(F.sha2("text", 256).alias("digest"), "first"))
    later = F.when(F.col("doc_id") > F.col("first"), F.lit("E")).otherwise(F.lit(""))
    judged = _meet(narrow.where("possible"), firsts, ["digest"], FEW)
    judged = judged.select("doc_id", "part", F.concat("fails", later).alias("fails"), "possible")
    return judged.union(narrow.where("not possible").select("doc_id", "part", "fails", "possible"))


def mask_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """Additive counts per part and set of failed filters: ``n``, ``good`` (quality 1) and ``toxic`` (toxic 1)."""
    same = flagged.groupBy("doc_id", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = settle(marked.agg(is_one("quality").alias("good"), is_one("toxic").alias("bad")))
    met = _meet(same, marked, ["doc_id"], FEW)
    share = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0))
    return met.groupBy("part", "fails").agg(F.sum("n").alias("n"), share("good").alias("good"), share("bad").alias("toxic"))


def orders_table(counts: DataFrame) -> DataFrame:
    """Figures of all 120 orders from mask counts; each row of ``counts`` meets each step of each order."""
    steps = (
        counts.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
        .withColumn("letter", F.expr("substr(filter_order, step, 1)"))
        .withColumn("fresh", F.expr("translate(fails, substr(filter_order, 1, step - 1), '') = fails"))
        .withColumn("hit", F.expr("instr(fails, letter) > 0"))
    )
    of = lambda rule, value="n": F.sum(F.expr(f"CASE WHEN {rule} THEN {value} ELSE 0L END"))
    return steps.groupBy("part", "filter_order", "step").agg(
        of("fresh AND NOT hit").alias("kept"), of("fresh AND hit").alias("removed"), of("hit AND NOT fresh").alias("redundant"),
        of("fails = letter").alias("unique_fails"), of("fresh AND hit", "good").alias("good_lost"),
        of("fresh AND hit", "toxic").alias("toxic_lost"), of("hit", f"n * ({len(ORDERS)} div length(fails))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (``lang``, null: empty), order of the filters ABCDE and step.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: over 3 in 100 code points are A-Z;
    D: holds one of ``#$%&*|``; E: the same text as a row of smaller doc_id in any part, removed or not.

    Null texts are empty texts, and equal to each other. Texts are taken whole, of any length. Rows
    of one doc_id and one text are no repeats of each other, but each is counted. A row without
    doc_id fails E never, makes no other fail it, and has no label. A document with several label rows
    is good or toxic if one of them says so. Empty tables give no rows; other columns are not looked at.
    """
    return orders_table(settle(mask_counts(flags(docs), labels)))


AUDIT_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT d.doc_id, part, [
      len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
      100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fail
  FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, fail, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fail),
o AS (SELECT unnest([{", ".join(f"'{o}'" for o in ORDERS)}]) AS filter_order),
s AS (
  SELECT part, filter_order, k AS step, m.n, m.good, m.bad, fail,
         list_transform(string_split(filter_order, ''), lambda c: ascii(c) - 64) AS seq
  FROM m, o, range(1, 6) AS r(k)),
x AS (
  SELECT *, fail[seq[step]] AS hit, list_bool_or(list_transform(seq[1:step - 1], lambda i: fail[i])) AS gone,
         len(list_filter(fail, lambda b: b)) AS failed FROM s),
y AS (SELECT *, coalesce(gone, false) AS before FROM x),
g AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
    coalesce(sum(n) FILTER (NOT hit AND NOT before), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (hit AND NOT before), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND before), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (hit AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT before), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (hit AND NOT before), 0)::BIGINT AS toxic_lost
  FROM y GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM g
"""
