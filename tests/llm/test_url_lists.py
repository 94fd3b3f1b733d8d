import random
from datetime import date, timedelta

from deltacell.llm import url_lists as U

DAY = date(2024, 1, 1)
SCHEMA = "list string, kind string, value string, action string, at date"


def brute(url, fetched, entries):
    if url is None or fetched is None:
        return (None, None, None)
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest.split("?")[0].split("#")[0].split("/")[0].split("@")[-1].split(":")[0].lower()
    parts = [x for x in rest.split("?")[0].split("#")[0].split("/")[1:] if x]
    best = None
    for lst, kind, value in {e[:3] for e in entries if None not in e}:
        own = sorted({(at, action) for a, b, c, action, at in entries if None not in (a, b, c, action, at) and (a, b, c) == (lst, kind, value) and at <= fetched})
        active = own and own[-1][1] == "add"
        hit = {
            "url": value == url, "host": value == host, "domain": "." in value and (host == value or host.endswith("." + value)),
            "prefix": any(value == host + "/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)),
        }[kind]
        if active and hit:
            key = (U.KINDS.index(kind), len(value), lst == "allow")
            best = max(best or (key, ()), (key, (lst, kind, value)))
    return best[1] if best else (None, None, None)


def test_matches_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.b.example.com", "b.example.com", "example.com", "x.org"]
    entries = [("block", "host", "x.org", "add", DAY), ("block", "host", "x.org", "remove", DAY), (None, "host", "x.org", "add", DAY)]
    for _ in range(150):
        kind = rng.choice(U.KINDS)
        h = rng.choice(hosts)
        value = {"host": h, "domain": h, "prefix": f"{h}/{rng.choice(['p', 'p/q', 'r'])}", "url": f"http://{h}/p/q?x=1"}[kind]
        entries.append((rng.choice(["block", "allow"]), kind, value, rng.choice(["add", "remove"]), DAY + timedelta(rng.randrange(400))))
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/p", "/p/q?x=1", "/p//q/s#f", "/r:8")] + ["HTTPS://u@A.b.example.com:80/p", "junk", "", None]
    rows = [(k, rng.choice(urls), DAY + timedelta(rng.randrange(420)), "x") for k in range(300)] + [(1000, urls[0], None, "x")]
    rows.append(rows[0])
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, list string")
    out = U.judge(captures, spark.createDataFrame(entries, SCHEMA)).collect()
    assert sorted(((r["page_id"], r["list"], r["kind"], r["value"]) for r in out), key=str) == sorted(
        ((k, *brute(u, t, entries)) for k, u, t, _ in rows), key=str)
    assert any(r["kind"] == "prefix" for r in out) and any(r["kind"] is None for r in out)


def test_long_urls_and_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://x.org/" + "a/" * 50_000, DAY)], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([("block", "prefix", "x.org/a/a", "add", DAY)], SCHEMA)
    assert [r["value"] for r in U.judge(captures, entries).collect()] == ["x.org/a/a"]
    assert [r["value"] for r in U.judge(captures, entries.where("false")).collect()] == [None]
    assert U.judge(captures.where("false"), entries).collect() == []
