"""Main text of web pages by template deduction over the pages of a host.

A page is read as a tree of structural elements, each known by its path (tags with their classes).
Over all pages of a host, elements with the same occurrence vector (how often they stand on each
page) form an equivalence class; vectors are compared by sums of page hashes, so classes need one
aggregate and no host is gathered in one task. Classes found on at least two pages are the
template, nested by their paths. What lies between template elements are slots: those with the
same text on every page are part of the template, those inside menus, headers, footers, sidebars,
notices, adverts, forms or comments are no content, and of the rest each page keeps the template
element with most text on the host's pages. Pages without one are judged by their own tree.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltacell.llm import words as W
from deltacell.llm.ids import FEW
from deltacell.session import settle

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?=[a-zA-Z/])[^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

# Names of elements, and words in class, id or role, by what they say about a part of a page.
RAW = frozenset("script style noscript template iframe object svg math textarea title".split())
_END = {name: re.compile(rf"</{name}[^>]*+(?:>|\Z)", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr td th caption figcaption".split())
OUTSIDE = frozenset("nav footer aside form head button select dialog menu header fieldset".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent notice alert popup modal newsletter subscribe subscription share sharing social related "
    "recommended comment comments reply replies discussion login signup search widget toolbar pagination".split())
MAIN = frozenset(("article", "main"))
#: Occurrence vectors are numbers below this.
VECTORS = 1 << 62


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """Path part of an element, and whether it is no content by its name or words."""
    words: list[str] = []
    if attributes and "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            words += _WORD.findall((m[1] or m[2] or m[3] or "").lower())
    return (f"{name}.{'.'.join(sorted(set(words)))}" if words else name), name in OUTSIDE or bool(OUTSIDE_WORDS.intersection(words))


class Page:
    """Blocks of a page in order: (node, text). A node is a structural element on the page."""

    def __init__(self, source: str):
        self.paths = [""]
        self.parents = [-1]
        self.outside = [False]
        self.names = [""]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = []
        node, run, at = 0, [], 0

        def close_block():
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    self.blocks.append((node, text))
                run.clear()

        while m := _TOKEN.search(source, at):
            if m.start() > at:
                run.append(source[at:m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if name == "br" or name in ("td", "th"):
                run.append(" ")
                continue
            if name in INLINE or name in VOID and name != "hr":
                continue
            if m[1]:
                close_block()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        node = stack[-1][1] if stack else 0
                        break
                continue
            if name in RAW:
                end = None if m[3].endswith("/") else _END[name].search(source, at)
                at = at if m[3].endswith("/") else end.end() if end else len(source)
                continue
            close_block()
            if name in PLAIN or name in ("hr", "html"):
                continue
            if name in MAIN:
                # An article inside a menu or the like that nobody closed: the page went on.
                while stack and self.outside[stack[-1][1]] and stack[-1][0] in OUTSIDE:
                    stack.pop()
                node = stack[-1][1] if stack else 0
            if m[3].endswith("/"):
                continue
            label, out = _label(name, m[3])
            inside = any(n in MAIN for n, _ in stack)
            if out and inside and (name == "header" or label.startswith("header.")):
                out = False
            if name in MAIN or name == "body":
                out = False
            self.paths.append(f"{self.paths[node]}/{label}")
            self.parents.append(node)
            self.outside.append(out or self.outside[node] and name not in MAIN)
            self.names.append(name)
            stack.append((name, len(self.paths) - 1))
            node = len(self.paths) - 1
        if at < len(source):
            run.append(source[at:])
        close_block()

    def totals(self) -> list[int]:
        """Characters of content at and below each node."""
        out = [0] * len(self.paths)
        for node, text in self.blocks:
            if not self.outside[node]:
                out[node] += len(text)
        for k in range(len(out) - 1, 0, -1):
            out[self.parents[k]] += out[k]
        return out

    def ids(self) -> list[int]:
        """Element of each node."""
        return [xxhash.xxh64_intdigest(p) >> 1 for p in self.paths]

    def main(self, best: set[int]) -> list[str]:
        """Blocks of the best template elements; without one, of the page's article, else of its densest element."""
        totals = self.totals()
        ids = self.ids()
        top = {k for k in range(len(ids)) if not self.outside[k] and ids[k] in best}
        if not top:
            top = {k for k in range(len(ids)) if self.names[k] in MAIN and totals[k]}
            if not top:
                best = totals[0]
                k = 0
                while True:
                    down = [c for c in range(k + 1, len(ids)) if self.parents[c] == k and totals[c] > 0.7 * best]
                    if not down:
                        break
                    k = down[0]
                top = {k}
        kept, inside = [], [False] * len(ids)
        for k in range(len(ids)):
            inside[k] = k in top or k > 0 and inside[self.parents[k]]
        for node, text in self.blocks:
            if inside[node] and not self.outside[node]:
                kept.append(text)
        return kept


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def elements(pages: DataFrame) -> DataFrame:
    """Per host and element path: pages, occurrence vector, characters, and hashes of its text to see whether it changes."""
    names = ["host", "element", "pages", "vector", "chars", "least", "most", "main", "parts"]

    def run(batches):
        held: dict[tuple, list] = {}

        def drained():
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in W.slices(batches):
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = source or ""
                page = Page(source)
                totals = page.totals()
                mark = xxhash.xxh64_intdigest(source)
                texts: dict[int, list[str]] = defaultdict(list)
                for node, text in page.blocks:
                    while node >= 0:
                        texts[node].append(text)
                        node = page.parents[node]
                seen: dict[int, list[int]] = defaultdict(list)
                for k, path in enumerate(page.paths):
                    if k and not page.outside[k]:
                        seen[xxhash.xxh64_intdigest(path) >> 1].append(k)
                for element, nodes in seen.items():
                    chars = sum(totals[k] for k in nodes)
                    text = xxhash.xxh64_intdigest("\n".join(t for k in nodes for t in texts[k])) >> 1
                    vector = (mark * (2 * len(nodes) + 1) >> 3) & ((1 << 44) - 1)
                    row = held.get((host, element))
                    if row is None:
                        held[host, element] = [1, vector, chars, text, text, page.names[nodes[0]] in MAIN, page.paths[nodes[0]].count("/")]
                    else:
                        row[0] += 1
                        row[1] = (row[1] + vector) % VECTORS
                        row[2] += chars
                        row[3], row[4] = min(row[3], text), max(row[4], text)
            if len(held) > 100_000:
                yield drained()
        if held:
            yield drained()

    parts = pages.mapInArrow(run, "host string, element long, pages long, vector long, chars long, least long, most long, main boolean, parts int")
    return summed(parts)


def summed(parts: DataFrame) -> DataFrame:
    """One row per host and element. Vectors are added modulo ``VECTORS``, so any number of pages of a host works."""
    vector = F.pmod(F.sum(F.col("vector").cast("decimal(20,0)")), F.lit(VECTORS).cast("decimal(20,0)")).cast("long").alias("vector")
    return parts.groupBy("host", "element").agg(
        F.sum("pages").alias("pages"), vector, F.sum("chars").alias("chars"), F.min("least").alias("least"),
        F.max("most").alias("most"), F.max("main").alias("main"), F.max("parts").alias("parts"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, element, known): elements of valid classes that hold changing text, with their weight.

    An article weighs more than any other element; of nested elements in one class the innermost
    with nearly all the text stands for it.
    """
    found = elements(pages)
    klass = Window.partitionBy("host", "vector", "pages")
    rows = found.where("pages >= 2").withColumn("full", F.max("chars").over(klass))
    rows = rows.where("least <> most and chars > 0 and chars >= 0.7 * full")
    inner = rows.withColumn("deep", F.row_number().over(klass.orderBy(F.desc("main"), F.desc("parts"), "element"))).where("deep = 1")
    weight = F.col("chars") / F.col("pages") + F.when(F.col("main"), 1e12).otherwise(0.0)
    return inner.select("host", "element", weight.alias("known"))


def page_elements(pages: DataFrame) -> DataFrame:
    """(host, mark, element) of the elements on each page that may be content; ``mark`` is a hash of the html, 128 bits."""
    def run(batches):
        for batch in W.slices(batches):
            hosts, marks, found = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                here = {e for e, out in zip(page.ids(), page.outside, strict=True) if not out}
                hosts += [host] * len(here)
                marks += [xxhash.xxh3_128_digest(source)] * len(here)
                found += here
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(marks, pa.binary()), pa.array(found, pa.int64())], ["host", "mark", "element"])

    return pages.where("html <> ''").mapInArrow(run, "host string, mark binary, element long")


def best_elements(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, mark, best): per page its ``found`` elements of the largest weight; a page without any has no row."""
    rows = page_elements(pages).join(found, ["host", "element"])
    held = rows.groupBy("host", "mark").agg(F.max("known").alias("top"), F.collect_set(F.struct("known", "element")).alias("all"))
    return held.select("host", "mark", F.expr("transform(filter(all, x -> x.known = top), x -> x.element)").alias("best"))


def _key(host: str, element: int) -> int:
    return xxhash.xxh64_intdigest(element.to_bytes(8, "little") + host.encode())


def gather(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of host and element, and their weights: 16 bytes a template element. Tasks pack them."""
    def packed(batches):
        for batch in batches:
            keys = np.array([_key(h, e) for h, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], "<u8")
            known = batch.column(2).to_numpy(zero_copy_only=False).astype("<f8")
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, known)], ["keys", "known"])

    rows = found.select("host", "element", "known").mapInArrow(packed, "keys binary, known binary").collect()
    keys, known = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("keys", "<u8"), ("known", "<f8")))
    order = np.argsort(keys)
    return keys[order], known[order]


def heaviest(page: Page, host: str, keys: np.ndarray, known: np.ndarray) -> set[int]:
    """Template elements of the largest weight on a page."""
    here = sorted({e for e, out in zip(page.ids(), page.outside, strict=True) if not out})
    if not len(keys) or not here:
        return set()
    wanted = np.array([_key(host, e) for e in here], np.uint64)
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    weight = np.where(keys[at] == wanted, known[at], -1.0)
    return {here[i] for i in np.flatnonzero(weight == weight.max())} if weight.max() >= 0 else set()


def extract(pages: DataFrame, few: int = FEW) -> DataFrame:
    """All columns of ``pages`` with ``text``: the main text, blocks joined by two newlines.

    ``pages`` needs url and html. A null or empty html, and a page with markup alone, has the empty
    text; a null url belongs to the host without a name. Repeated rows repeat; an empty table gives
    an empty table. A column named ``text`` is replaced. Up to ``few`` template elements are sent to
    every executor and no html moves; beyond that pages meet theirs in a join, with the same result.
    """
    W.text_batches(pages)
    hosted = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    found = settle(templates(hosted))
    kept = [f for f in pages.schema.fields if f.name != "text"]
    # The html is carried once; only one that is no string stays beside its text.
    beside = [f for f in kept if f.name != "html" or f.dataType != T.StringType()]
    given = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{f.name}`") for f in beside]).alias("given"),
                         F.col("html").cast("string").alias("_html"), host_of(F.col("url")).alias("_host"))
    schema = T.StructType([given.schema["given"], given.schema["_html"], T.StructField("text", T.StringType())])

    def texted(batches, best_of):
        for batch in W.slices(batches):
            given, sources, others = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            out = []
            for source, other in zip(sources.to_pylist(), others, strict=True):
                page = Page(source) if source else None
                out.append("\n\n".join(page.main(best_of(page, other))) if source else "")
            yield pa.RecordBatch.from_arrays([given, sources, pa.array(out, pa.string())], ["given", "_html", "text"])

    if found.count() <= few:
        shared = pages.sparkSession.sparkContext.broadcast(gather(found))
        out = given.mapInArrow(lambda batches: texted(batches, lambda page, host: heaviest(page, host, *shared.value)), schema)
    else:
        best = settle(best_elements(hosted, found))

        def marked(batches):
            for batch in W.slices(batches):
                mark = [xxhash.xxh3_128_digest(source or "") for source in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mark, pa.binary())], names=[*batch.schema.names, "_mark"])

        given = given.mapInArrow(marked, T.StructType([*given.schema.fields, T.StructField("_mark", T.BinaryType())]))
        best = best.select(F.col("host").alias("_host"), F.col("mark").alias("_mark"), F.col("best").alias("_best"))
        given = given.join(best, ["_host", "_mark"], "left").select("given", "_html", "_best")
        out = given.mapInArrow(lambda batches: texted(batches, lambda _, best: {*(best or ())}), schema)
    of = lambda f: F.col("given").getField(f.name) if f in beside else F.col("_html")
    return out.select(*[of(f).alias(f.name) for f in kept], "text")


def texts(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
