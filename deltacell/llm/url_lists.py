"""URL filters that follow dated lists: each capture is judged by the entries active when it was fetched.

Additions and removals of an entry become validity intervals ``[start, stop)``. A capture offers the
keys that an entry may have: its whole URL, its path prefixes, its host, and the domains above it.
An as-of join brings keys and intervals together: both sides carry the period of time they fall
in, so a key with a long history meets only the intervals of the capture's own period. Of the
active entries the most specific one decides. All of it is DataFrame operations; captures with the
same URL and time are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltacell.session import settle

PERIOD_DAYS = 64
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
#: Kinds by how specific they are.
KINDS = ("domain", "host", "prefix", "url")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, start, stop) from dated ``add`` and ``remove`` rows; an open interval has no stop.

    Rows of one entry are ordered by time, additions before removals of the same time, so an entry
    that is added and removed at once is never active. A second addition changes nothing, nor does a
    removal of what is not there. Rows with a null in any column, or of another kind or action, are
    ignored.
    """
    sound = entries.select("list", "kind", "value", "action", "at").dropna()
    sound = sound.where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove")).distinct()
    own = Window.partitionBy("list", "kind", "value").orderBy("at", "action")
    turns = sound.withColumn("_last", F.lag("action").over(own)).where(
        F.col("action") != F.coalesce("_last", F.lit("remove")))
    spans = turns.withColumn("stop", F.lead("at").over(own)).where("action = 'add' and (stop is null or stop > at)")
    return spans.select("list", "kind", "value", F.col("at").alias("start"), "stop")


def _period(t: Column) -> Column:
    return F.floor(F.unix_date(t.cast("date")) / PERIOD_DAYS).cast("int")


def keys(depth: int) -> Column:
    """Array of (kind, value, reach) of a row's ``url``: what an entry would have to say to match it.

    ``depth`` is the number of path parts of the deepest prefix on any list; longer ones cannot match.
    """
    labels = F.split(F.col("_host"), r"\.")
    n = F.size(labels)
    domains = F.when(
        n >= 2,
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")),
    ).otherwise(F.array().cast("array<string>"))
    parts = F.slice(F.filter(F.split(path(F.col("url")), "/"), lambda x: x != ""), 1, max(depth, 1))
    m = F.size(parts)
    prefixes = F.when(
        (m > 0) & F.lit(depth > 0),
        F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(F.col("_host"), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))),
    ).otherwise(F.array().cast("array<string>"))

    def typed(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(typed("domain", domains), typed("host", F.array("_host")), typed("prefix", prefixes), typed("url", F.array("url")))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All columns of ``captures`` with ``list``, ``kind`` and ``value`` of the deciding entry, null where none is active.

    ``captures`` needs url and fetched; ``entries`` needs list (block or allow), kind, value, action
    and at. An entry is active from its addition up to, not including, its removal. The most
    specific kind decides, of one kind the longest value, of one value ``allow`` before ``block``.
    A null url or time matches nothing. Repeated rows are judged alike; empty tables give empty or
    unmatched rows. Columns of ``captures`` named list, kind or value are replaced; others are kept.
    """
    spans = settle(intervals(entries))
    depth = spans.where("kind = 'prefix'").agg(F.max(F.size(F.split("value", "/")) - 1)).first()[0] or 0
    asked = captures.where("url is not null and fetched is not null").select("url", "fetched").distinct()
    last = asked.agg(F.max("fetched").alias("t"), F.min("fetched").alias("s")).first()
    if last["t"] is None:
        spans = spans.where("false")
    until = F.least(F.coalesce("stop", F.lit(last["t"])), F.lit(last["t"]))
    since = F.greatest("start", F.lit(last["s"]))
    dealt = spans.where(since <= until).withColumn("period", F.explode(F.sequence(_period(since), _period(until))))
    offered = asked.withColumn("_host", host(F.col("url"))).withColumn("period", _period(F.col("fetched")))
    offered = offered.select("url", "fetched", "period", F.explode(keys(int(depth))).alias("_k")).select("url", "fetched", "period", "_k.*")
    met = offered.join(dealt, ["kind", "value", "period"]).where("fetched >= start and (stop is null or fetched < stop)")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = met.groupBy("url", "fetched").agg(
        F.max_by(F.struct("list", "kind", "value"), F.struct(rank, F.length("value"), F.col("list") == "allow", "list")).alias("_e"))
    names = [c for c in captures.columns if c not in ("list", "kind", "value")]
    given = captures.select("url", "fetched", *[F.col(f"`{c}`").alias(f"_given{k}") for k, c in enumerate(names)])
    out = given.join(best, ["url", "fetched"], "left")
    return out.select(*[F.col(f"_given{k}").alias(c) for k, c in enumerate(names)], F.col("_e.list").alias("list"), F.col("_e.kind").alias("kind"), F.col("_e.value").alias("value"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: page_id, url, and a day of 2024 taken from the digest of id and URL."""
    day = F.conv(F.substring(F.md5(F.concat_ws("|", "page_id", "url").cast("binary")), 1, 6), 16, 10).cast("int") % 366
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Changes of a block and an allow list over the hosts, domains, first path parts and URLs of all pages."""
    urls = pages.where("url is not null").select("url").distinct().withColumn("h", host(F.col("url")))
    first = F.regexp_extract(path(F.col("url")), "^/([^/]+)", 1)
    values = (
        urls.select(F.lit("host").alias("kind"), F.col("h").alias("value"))
        .union(urls.where("h rlike '[.].*[.]'").select(F.lit("domain"), F.regexp_replace("h", r"^[^.]*\.", "")))
        .union(urls.where(first != "").select(F.lit("prefix"), F.concat("h", F.lit("/"), first)))
        .union(urls.select(F.lit("url"), F.col("url")))
    ).where("value <> ''").distinct()
    n = F.conv(F.substring(F.md5(F.concat_ws("|", "kind", "value").cast("binary")), 1, 6), 16, 10).cast("int")
    values = values.withColumn("n", n)

    def change(action, day, where):
        return values.where(where).select(
            F.when(F.col("n") % 4 == 0, "allow").otherwise("block").alias("list"), "kind", "value", F.lit(action).alias("action"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.expr(day).cast("int")).alias("at"))

    return change("add", "n % 300", "true").union(change("remove", "n % 300 + 20 + n % 60", "n % 3 > 0")).union(
        change("add", "n % 300 + 120", "n % 3 = 2"))


#: The same judgement in DuckDB SQL.
LISTS_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (('0x' || substr(md5(concat_ws('|', page_id, url)), 1, 6))::INT % 366) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS h,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p
  FROM pages
), vals AS (
  SELECT 'host' AS kind, h AS value FROM captures WHERE url IS NOT NULL
  UNION SELECT 'domain', regexp_replace(h, '^[^.]*\.', '') FROM captures WHERE regexp_matches(h, '[.].*[.]')
  UNION SELECT 'prefix', h || '/' || regexp_extract(p, '^/([^/]+)', 1) FROM captures WHERE regexp_extract(p, '^/([^/]+)', 1) <> ''
  UNION SELECT 'url', url FROM captures WHERE url IS NOT NULL
), v AS (
  SELECT *, ('0x' || substr(md5(kind || '|' || value), 1, 6))::INT AS n FROM vals WHERE value <> ''
), e AS (
  SELECT CASE WHEN n % 4 = 0 THEN 'allow' ELSE 'block' END AS list, kind, value, n,
         DATE '2024-01-01' + n % 300 AS start,
         CASE WHEN n % 3 > 0 THEN DATE '2024-01-01' + (n % 300 + 20 + n % 60) END AS stop FROM v
  UNION ALL
  SELECT CASE WHEN n % 4 = 0 THEN 'allow' ELSE 'block' END, kind, value, n, DATE '2024-01-01' + (n % 300 + 120), NULL FROM v WHERE n % 3 = 2
), m AS (
  SELECT c.page_id, c.url, c.fetched, e.list, e.kind, e.value,
    row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched
      ORDER BY CASE e.kind WHEN 'url' THEN 4 WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(e.value) DESC, e.list) AS k
  FROM captures c JOIN e ON c.fetched >= e.start AND (e.stop IS NULL OR c.fetched < e.stop) AND (
    e.kind = 'url' AND e.value = c.url OR e.kind = 'host' AND e.value = c.h
    OR e.kind = 'domain' AND (e.value = c.h OR ends_with(c.h, '.' || e.value))
    OR e.kind = 'prefix' AND e.value = c.h || '/' || regexp_extract(c.p, '^/+([^/]+)', 1))
)
SELECT c.page_id, c.url, c.fetched, m.list, m.kind, m.value FROM captures c
LEFT JOIN m ON m.page_id = c.page_id AND m.url = c.url AND m.fetched = c.fetched AND m.k = 1
"""
