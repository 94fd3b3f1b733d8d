from deltacell.llm import template as X


def page(k, body, extra="", host="a.example.org", shell=True):
    html = (
        f'<!DOCTYPE html><html><head><title>T{k}</title><style>p{{x:">"}}</style><script>var t="</p>";if(a<b){{}}</script></head><body>'
        f'<nav><ul><li><a href="/x">Menu {k}</a></li></ul></nav><!-- c <p>no</p> --><div class="ad">Buy {k}</div>{extra}{body}'
        f'<aside>Side {k}</aside><form><label>Name</label><input></form><footer>&copy; foot {k}</footer></body></html>'
    )
    return (k, f"https://{host}/p/{k}", html)


def rows():
    out = [page(k, f"<article><h1>Title &amp; {k}</h1><p>One <b>bold</b>\n two.<br>three<p>Last {k}</article>") for k in range(4)]
    out += [page(10 + k, f'<div class="post"><div class="body"><p>Main {k} text that is long</p><p>and &eacute; more</p></div></div>'
                         f'<div class="comments"><p>reader says {k}</p></div>', host="b.example.org:80") for k in range(4)]
    out.append(page(20, "<div><p>Only page of its host, with text</p></div>", host="c.example.org"))
    out.append((21, None, None))
    out.append((22, "https://a.example.org/e", ""))
    out.append((23, "https://a.example.org/e", "<article><p>cut &am"))
    out.append((24, "nothing", "plain text"))
    out.append((25, "https://a.example.org/e", "<nav><ul><li>x<article><p>Body 25</p></article></nav><p>y"))
    out.append((26, "https://a.example.org/l", "<article>" + "<p>word </p>" * 30000))
    return out


def test_extraction(spark):
    given = rows() + [rows()[0]]
    out = X.texts(spark.createDataFrame(given, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as host")).collect()
    assert len(out) == len(given)
    got = {r["page_id"]: r["text"] for r in out}
    for k in range(4):
        assert got[k] == f"Title & {k}\n\nOne bold two. three\n\nLast {k}"
        assert got[10 + k] == f"Main {k} text that is long\n\nand é more"
    assert got[20] == "Only page of its host, with text" and got[21] == got[22] == ""
    assert got[23] == "cut &am" and got[24] == "plain text" and got[25] == "Body 25"
    assert got[26] == "\n\n".join(["word"] * 30000)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_a_class_holds_on_every_page(spark):
    df = spark.createDataFrame([(h, p) for _, u, p in rows()[:8] for h in [u.split("/")[2].split(":")[0]]], "host string, html string")
    found = {(r["host"], r["pages"]) for r in X.elements(df).collect()}
    assert ("a.example.org", 4) in found and ("b.example.org", 4) in found
    known = {r["host"]: r["known"] for r in X.templates(df).collect()}
    assert set(known) == {"a.example.org", "b.example.org"}


def test_empty(spark):
    assert X.texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_vectors_of_any_number_of_pages_add_up(spark):
    big = (1 << 62) - 3
    row = ("h", 1, 10**6, big, 5, 1, 2, False, 1)
    parts = spark.createDataFrame([row] * 50, "host string, element long, pages long, vector long, chars long, least long, most long, main boolean, parts int")
    (r,) = X.summed(parts).collect()
    assert r["vector"] == 50 * big % X.VECTORS and r["pages"] == 50 * 10**6


def test_no_layout_of_a_host_is_too_many(spark):
    given = []
    for k in range(100):
        for n in range(2):
            name = f"{chr(97 + k // 10)}{chr(97 + k % 10)}x"
            body = f'<div class="{name}"><div class="{name}lead"><p>Lead {n}</p></div><div class="{name}main"><p>{"Words " * (10 + k)}{n}</p></div>'
            given.append(page(1000 + 2 * k + n, body + f'<div class="{name}end"><p>{"More " * (6 + k // 2)}</p></div></div>', host="many.example.org"))
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    known = X.templates(df.select(X.host_of("url").alias("host"), "html"))
    assert known.count() > 64
    got = {r["page_id"]: r["text"] for r in X.texts(df).collect()}
    layouts = {k: [got[1000 + 2 * k + n].replace(f" {n}", " #") for n in range(2)] for k in range(100)}
    alone = {r["page_id"]: r["text"] for k in (0, 50, 99) for r in X.texts(df.where(f"page_id in ({1000 + 2 * k}, {1001 + 2 * k})")).collect()}
    assert all(a == b for a, b in layouts.values()) and all(got[i] == t for i, t in alone.items())


def test_html_does_not_move_where_template_elements_are_few(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").selectExpr("*", "cast(html as binary) as raw")
    wanted = X.extract(df, few=0).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = X.extract(df)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.columns == [*df.columns, "text"] and sorted(map(str, found.collect())) == sorted(map(str, wanted))
        binary = X.extract(df.select("page_id", "url", df.raw.alias("html"))).select("page_id", "text")
        assert sorted(map(str, binary.collect())) == sorted(str(r) for r in found.select("page_id", "text").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
