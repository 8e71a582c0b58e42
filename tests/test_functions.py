"""Literal cases of functions, decisions and analyzers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siteloom.functions import pages as html
from siteloom.functions import urls
from siteloom.operators import analyzers, crawl, reads, writes


def _one(spark, expr, *values):
    df = spark.createDataFrame([tuple(map(str, values))], [f"v{k}" for k in range(len(values))])
    return df.select(expr(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(
    ("prev", "cur", "want"),
    [
        ("https://e.com/page/1", "https://e.com/page/2", (1, 1, 2)),
        ("https://e.com/page/10", "https://e.com/page/20", (1, 10, 20)),
        ("https://e.com/a?p=1&q=x", "https://e.com/a?p=2&q=x", (1, 1, 2)),
        ("https://e.com/a?q=x&p=3", "https://e.com/a?p=4&q=x", (1, 1, 4)),
        ("https://e.com/page/2", "https://e.com/page/1", None),
        ("https://e.com/page/1", "https://e.com/page/1", None),
        ("https://e.com/a/1", "https://e.com/b/2", None),
        ("https://e.com/page/1", "https://f.com/page/2", None),
        ("https://e.com/page/a", "https://e.com/page/b", None),
        ("https://e.com/page/1", "https://e.com/page/1/2", None),
        ("https://e.com/page/", "https://e.com/page/1", (1, 1, 1)),
        ("https://e.com/?p=1", "https://e.com/?q=2", None),
    ],
)
def test_pagination(spark, prev, cur, want):
    got = _one(spark, crawl.pagination, prev, cur)
    assert (tuple(got) if got else None) == want


def test_predicted(spark):
    rows = spark.createDataFrame([("https://e.com/a?b=x%20y&p=2", (2, 2, 2))], "url string, pattern struct<tokenIndex:int,step:bigint,currentNumber:bigint>")
    got = [r.predicted for r in crawl.predicted(rows, 2).orderBy("i").collect()]
    assert got == ["https://e.com/a?b=x%2520y&p=4", "https://e.com/a?b=x%2520y&p=6"]


def test_accepted_patterns(spark):
    rows = [(0, k, f"https://e.com/p/{k}", True) for k in range(1, 7)] + [(0, 7, "https://x.com/", False), (0, 8, "https://e.com/p/8", True), (0, 9, "https://e.com/p/9", True)]
    got = {r.seq for r in crawl.accepted_patterns(spark.createDataFrame(rows, "crawl int, seq int, url string, full boolean")).filter("pattern IS NOT NULL").collect()}
    assert got == {2, 4, 6, 9}


def test_skip_and_scope(spark):
    skip = lambda u, g, p: _one(spark, lambda x: urls.should_skip(x, g, p), u)
    assert skip("https://e.com/blog/2020/01", ["/blog/*"], []) and not skip("https://e.com/news", ["/blog/*"], [])
    assert skip("http://e.com/a", [], ["https://e.com/"]) and not skip("https://e.org/", [], ["https://e.com/"])
    assert _one(spark, lambda x: urls.is_lower_layer(x, "https://e.com/docs/"), "https://e.com/docs/a/b")
    assert not _one(spark, lambda x: urls.is_lower_layer(x, "https://e.com/docs/"), "https://e.com/document")
    assert _one(spark, urls.without_hash_and_auth, "https://u:p@e.com/a#b") == "https://e.com/a"
    assert _one(spark, urls.decode_safely, "%E3%81%82+%") == "%E3%81%82+%" and _one(spark, urls.decode_safely, "a+%20") == "a+ "
    assert _one(spark, lambda x: urls.natural_key(x), "https://e.com/a2") < _one(spark, lambda x: urls.natural_key(x), "https://e.com/a10")
    assert _one(spark, urls.normalized, "https://e.com//a//b?PHPSESSID=1&x=2") == "https://e.com/a/b?x=2"
    assert urls.scope_list(" a, b,") == ["a", "b"] and urls.string_regex("/a.b/i") == "(?i)a.b"


def test_robots(spark):
    body = "User-agent: *\nDisallow: /secret/\nAllow: /\n\nUser-agent: named\nDisallow: /admin/\n"
    assert urls.robots_rules(body, "other/2") == [(False, "/secret/"), (True, "/")] and urls.robots_rules(body, "named") == [(False, "/admin/")]
    rules = spark.createDataFrame([("https://e.com", a, p, urls.robots_regex(p)) for a, p in urls.robots_rules(body, "other")], "origin string, allow boolean, pattern string, regex string")
    rows = spark.createDataFrame([("https://e.com/secret/x",), ("https://e.com/a",), ("https://f.com/secret/",), ("ftp://e.com/secret/",)], ["url"])
    assert {r.url: r.allowed for r in urls.robots_allowed(rows, rules).collect()} == {"https://e.com/secret/x": False, "https://e.com/a": True, "https://f.com/secret/": True, "ftp://e.com/secret/": True}


PAGE = """<html lang=ja><head><title> T </title><meta name=description content=D><meta property=og:title content=O><meta name=robots content="noindex, nofollow"><link rel=canonical href=/c></head>
<body><div id=content><p>first</p></div><main><h1>Head</h1><p>a b　c<img src=x alt=y width=10 loading=lazy><table><thead><tr><th colspan=2>h</table><script>word()</script></main></body></html>"""


def test_meta_and_images():
    root = html.dom(PAGE)
    m = html.meta(root)
    assert (m["title"], m["lang"], m["description"], m["og_title"], m["canonical"], m["og_url"]) == ("T", "ja", "D", "O", "/c", "")
    assert (m["noindex"], m["nofollow"], m["noarchive"]) == (True, True, False)
    (i,) = html.images(root)
    assert (i["src"], i["alt"], i["width"], i["height"], i["isLazy"]) == ("x", "y", 10.0, 0.0, True)


def test_main_contents():
    found = html.main_contents(html.dom(PAGE))
    assert found["wordCount"] == 5  # document order: #content comes before main
    found = html.main_contents(html.dom(PAGE.replace("id=content", "")))
    assert (found["wordCount"], found["headings"], found["images"], found["table"]) == (len("Headabch") + len("word()"), 1, 1, 1)
    assert found["note"].splitlines()[1] == "|  1|   1 | o | x | o |"
    assert html.main_contents(html.dom("<p>x</p>")) is None


def test_search():
    root = html.dom('<div title="key" class="key"><p>key key</p><script>key</script><style>key</style><i data-a="key">no</i></div>')
    assert html.keyword_count(root, html.keyword_pattern("key")) == 2
    assert html.keyword_count(root, html.keyword_pattern("/(k)(e)y/i")) == 6
    assert html.first(root, "div > p") is not None and html.first(root, "p > div") is None and html.first(root, ".key p, b") is not None
    with pytest.raises(ValueError):
        html.selector("a:::")


def test_analyze_isolates_failures(spark):
    def each_page(url, source):
        if url.endswith("bad"):
            raise RuntimeError("no")
        return [("c", len(source), None)], [{"validator": "v", "severity": "error", "rule": "r", "code": "", "message": "m"}]

    a = analyzers.Analyzer("analyze-a", {"c": "C"}, each_page=each_page)
    b = analyzers.Analyzer("analyze-b", {"c": "C2"}, each_url=lambda url, external: ([("c", external, None)], []))
    pages = spark.createDataFrame([("u/1", "abc", 0), ("u/bad", "x", 0), ("u/none", None, 1)], "url string, html string, isExternal int")
    rows = analyzers.analyze(pages, [a, b]).cache()
    assert {r.url: (r.value, r.value_type) for r in analyzers.merged(rows).collect()} == {"u/1": ("false", "boolean"), "u/bad": ("false", "boolean"), "u/none": ("true", "boolean")}
    assert [r.url for r in rows.filter("kind = 'error'").collect()] == ["u/bad"] and rows.filter("kind = 'violation'").count() == 1
    assert analyzers.headers([a, b]) == {"c": "C2"} and analyzers.load({"analyze-search": False}) == []


def test_writes(spark):
    rec = spark.createDataFrame([(1, "a", ["b", "a"]), (2, "x", ["y", "z"]), (3, "y", None), (4, "x", ["w"])], "seq int, url string, redirectPaths array<string>")
    assert {r.hop: r.dest for r in writes.redirect_hops(rec).collect()} == {"a": "a", "b": "a", "x": "w", "y": "z"}
    known = spark.createDataFrame([(7, "a")], "id long, url string")
    got = {r.url: r.id for r in writes.ids_for_urls(known, spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], ["url"])).collect()}
    assert got["a"] == 7 and sorted(got.values()) == [7, 8, 9]
    pages = spark.createDataFrame([(1, "https://e.com/p10", 0), (2, "https://e.com/p2", 0), (3, "https://x.com/", 1)], "id long, url string, isExternal int")
    assert {r.id: r.order for r in writes.url_order(pages, urls.natural_key(F.col("url"))).collect()} == {2: 1, 1: 2, 3: None}


def test_crawl_rounds(spark):
    from siteloom.plans.commands import crawl_corpus
    from siteloom.sources.scratch import kept

    links = [("https://e.com/", "https://e.com/a", 0), ("https://e.com/", "http://e.com/a#x", 1), ("https://e.com/", "https://out.com/", 2), ("https://e.com/a", "https://e.com/", 0), ("https://e.com/a", "https://e.com/skip/b", 1)]
    found = crawl_corpus(
        spark.createDataFrame([("https://e.com/",)], ["url"]), spark.createDataFrame(links, "url string, href string, pos int"), ["https://e.com/"],
        crawl.CrawlConfig(excludes=["/skip/*"]), kept,
    )
    assert {r.key: (r["mode"], r["round"], r.action) for r in found.collect()} == {
        "//e.com/": ("full", 0, "fetch"), "//e.com/a": ("full", 1, "fetch"), "//out.com/": ("metadata", 1, "fetch"), "//e.com/skip/b": ("full", 2, "skip")
    }


def test_golden_redirects(spark):
    """A redirect to a missing page drops out, and a redirected destination is one hop away only."""
    pages = spark.createDataFrame([(1, "u1", 2), (2, "u2", 3), (3, "u3", None), (4, "u4", 99)], "id int, url string, redirectDestId int")
    assert {(r.fromId, r.toId) for r in reads.redirect_map(pages).collect()} == {(1, 2), (2, 3), (3, 3)}


def test_archive_round_trip(spark, tmp_path):
    from siteloom.sources.archive import read_archive, url_list, write_archive

    write_archive({"pages": spark.range(3)}, str(tmp_path / "a"))
    assert set(read_archive(spark, str(tmp_path / "a"))) == {"pages"}
    (tmp_path / "list.txt").write_text(" https://e.com/ \n\nhttps://f.com/\n")
    assert sorted(r.url for r in url_list(spark, str(tmp_path / "list.txt")).collect()) == ["https://e.com/", "https://f.com/"]


def test_anchors_of_any_form(spark):
    from siteloom.functions import pages

    source = """<a href="/a"><img src=x></a><a href='/b'>one <b>two</b></a><a href=c?x=1&amp;y=2>bare</a><map><area href="//o.example/d" alt=z></map>
<A class=k HREF="http://p.example/e">T &lt; U</A><a name=n>no link</a><script>"<a href='/no'>x</a>"</script><!-- <a href="/no">x</a> -->"""
    table = spark.createDataFrame([(1, "https://h.example/dir/p", source), (2, None, None)], "page_id long, url string, html string")
    got = sorted((r.pos, r.href, r.text) for r in pages.anchors(table).collect())
    assert got == [
        (0, "https://h.example/a", ""), (1, "https://h.example/b", "one two"), (2, "https://h.example/dir/c?x=1&y=2", "bare"),
        (3, "https://o.example/d", ""), (4, "http://p.example/e", "T < U"),
    ]


def test_deep_and_unclosed_markup():
    """A page's depth is bounded by nothing; steps grow with its length."""
    n = 40_000
    deep = html.dom("<p><table>" + "<div class=x>" * n + "<main><h2>t</h2><a href='/q'>w</a>" + "</i>" * n)
    assert sum(e.tag == "div" for e in deep.walk()) == n and deep.text() == "tw"
    assert html.main_contents(deep)["wordCount"] == 2 and html.links(deep) == [("/q", "w")]
    assert html.meta(deep)["title"] == "" and html.keyword_count(deep, html.keyword_pattern("w")) == 1


def test_implied_ends():
    shape = lambda e: f"{e.tag}({','.join(shape(c) if isinstance(c, html.Element) else c for c in e.children)})"
    assert shape(html.dom("<p>a<p>b<div>c</div>")) == "#document(p(a),p(b),div(c))"
    assert shape(html.dom("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")) == "#document(ul(li(a),li(b,ul(li(c))),li(d)))"
    assert shape(html.dom("<p>a<table><td><p>b<p>c</table>d")) == "#document(p(a),table(td(p(b),p(c))),d)"
    assert shape(html.dom("<p>a<span>b<li>c</li></b>d")) == "#document(p(a,span(b,li(c),d)))"
    assert shape(html.dom("<li><p>a<li>b")) == "#document(li(p(a)),li(b))"


def test_title_reads_bytes(spark):
    rows = [(1, "é" * 8000 + "<title> a </title>"), (2, "é" * 8192 + "<title>b</title>"), (3, "e" * 16000 + "<title>c</title>"), (4, None)]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k int, h string").select("k", html.title(F.col("h")).alias("t")).collect()}
    assert got == {1: "a", 2: "", 3: "c", 4: None}


def test_output_path(tmp_path):
    from siteloom.plans.commands import output_path

    assert output_path("a", "zip", str(tmp_path)) == f"{tmp_path}/a.zip"
    assert output_path(f"{tmp_path}/b.zip", "zip", "/") == f"{tmp_path}/b.zip"
    with pytest.raises(FileNotFoundError):
        output_path("none/a", "zip", str(tmp_path))
