"""Columns of any name pass through, and numbers of any length are read."""

from datetime import date

from deltacell.llm import mixing, pii, template, url_lists


def test_mixing_carries_clashing_columns(spark):
    names = ["_key", "_tokens", "_order", "_block", "_d", "_given", "_draws", "_run"]
    rows = [(i, "one two three", "s", *[f"{n}{i}" for n in names]) for i in range(20)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(rows) and out.count() == 20


def test_url_lists_carry_clashing_columns(spark):
    captures = spark.createDataFrame([("http://a.b.c/x", date(2024, 5, 1), 7, 8, 9)], "url string, fetched date, _e int, _given int, _k int")
    entries = spark.createDataFrame([("block", "host", "a.b.c", "add", date(2024, 1, 1))], "list string, kind string, value string, action string, at date")
    r = url_lists.judge(captures, entries).collect()
    assert [(x["_e"], x["_given"], x["_k"], x["list"]) for x in r] == [(7, 8, 9, "block")]


def test_template_carries_clashing_columns(spark):
    html = "<html><body><article><p>A long enough paragraph of text that is an article.</p></article></body></html>"
    rows = [(i, f"http://h/{i}", html, 1, 2, 3, 4, 5) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _host int, _html int, _mark int, _best int, given int")
    out = template.extract(pages)
    assert out.columns == [*pages.columns, "text"]
    assert {tuple(r)[:8] for r in out.collect()} == set(rows) and {r.text for r in out.collect()} == {r["text"] for r in template.extract(pages.select("page_id", "url", "html")).collect()}


def test_long_numbers_in_addresses():
    zeros = "0" * 6000
    assert pii.base_spans(f"1.{zeros}1.2.3") == [("ip", 0, 6007)]
    assert not [s for s in pii.base_spans(f"1.{zeros}256.2.3 {'9' * 6000}.1.1.1") if s[0] == "ip"]
