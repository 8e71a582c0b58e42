"""The commands on small archives: crawl, analyze, report, and what they write."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siteloom.operators import analyzers, crawl, reads, writes
from siteloom.plans import commands
from siteloom.sources.archive import derived_archive
from siteloom.sources.scratch import kept
from siteloom.streaming import frontier

SITE = {
    "https://e.com/": ["/a#x", "http://e.com/a", "/c?q=1"], "https://e.com/a": ["/b", "https://other.org/p"], "https://e.com/b": ["/", "/d"],
    "https://e.com/c?q=1": ["/f"], "https://e.com/d": ["/g"], "https://e.com/g": [], "https://e.com/f": [], "https://other.org/p": ["/z"],
}


@pytest.fixture(scope="module")
def site(spark):
    full = lambda h: h if "//" in h else f"https://e.com{h}"
    pages = spark.createDataFrame([(u, "<p>closed</p>" if u.endswith("/d") else "<p>x</p>") for u in SITE], "url string, html string")
    links = [(u, full(h) if u.startswith("https://e.com") else f"https://other.org{h}", k) for u, hs in SITE.items() for k, h in enumerate(hs)]
    return pages, spark.createDataFrame(links, "url string, href string, pos int")


def _found(df):
    return {r.key.removeprefix("//"): (r.mode, r.action, r.reason) for r in df.collect()}


def test_crawl_follows_links_behind_fragments(site):
    got = _found(commands.crawl_corpus(*site, ["https://e.com/"], crawl.CrawlConfig(), kept))
    assert set(got) == {"e.com/", "e.com/a", "e.com/c?q=1", "e.com/b", "other.org/p", "e.com/d", "e.com/f", "e.com/g"}
    assert got["other.org/p"][0] == "metadata" and got["e.com/g"] == ("full", "fetch", None)


def test_crawl_options(site):
    pages, links = site
    run = lambda **options: _found(commands.crawl_corpus(pages, links, ["https://e.com/"], crawl.CrawlConfig(**options), kept))
    closed = run(excludeKeywords=["closed"])
    assert closed["e.com/d"] == ("full", "skip", "keyword") and "e.com/g" not in closed
    assert "other.org/p" not in run(fetchExternal=False)
    assert "e.com/c" in run(disableQueries=True) and run(excludes=["/b*"])["e.com/b"][1:] == ("skip", "excluded")


def test_crawl_of_a_list_and_resumed(spark, site):
    listed = _found(commands.crawl_list(*site, ["https://e.com/a", "https://e.com/b"], crawl.CrawlConfig(), kept))
    assert {k: v[0] for k, v in listed.items()} == {"e.com/a": "full", "e.com/b": "full", "other.org/p": "metadata", "e.com/": "metadata", "e.com/d": "metadata"}
    state = spark.createDataFrame([("https://e.com/", 1), ("http://e.com/a", 1), ("https://e.com/b", 0)], "url string, scraped int")
    resumed = _found(commands.crawl_corpus(*site, ["https://e.com/"], crawl.CrawlConfig(), kept, resume=state))
    assert set(resumed) == {"e.com/b", "e.com/d", "e.com/g"}


def test_results_are_routed(spark):
    rows = [("a", "success", 200, None, None, False), ("b", "skipped", None, None, "excluded", False), ("c", "error", None, "net::ERR_NAME_NOT_RESOLVED", None, False), ("d", "error", 500, "x", None, False), ("e", "success", 404, None, None, True), ("f", "success", 200, None, None, True)]
    got = commands.routed(spark.createDataFrame(rows, "url string, kind string, status int, error string, reason string, predicted boolean"))
    assert [r.url for r in got["pages"].collect()] == ["a", "f"] and [tuple(r) for r in got["skipped"].collect()] == [("b", "excluded")]
    assert {r.url: r.status for r in got["errors"].collect()} == {"c": -1, "d": 500} and [r.url for r in got["discarded"].collect()] == ["e"]


def test_page_json_has_all_fields(spark, sf):
    a = derived_archive(spark, sf)
    rows = reads.page_json(a["anchors"], a["pages"]).orderBy("id").limit(20).collect()
    one = json.loads(rows[8].json)
    assert len(one) == 31 and one["redirectFrom"][0]["fromId"] == 9 and len(one["getAnchors"]) == 5
    assert reads.pages_with_refs(a["anchors"], a["pages"], with_refs=False).columns == a["pages"].columns
    assert reads.one_value(a["info"], "name") == "crawl"
    with pytest.raises(ValueError):
        reads.one_value(a["info"].limit(0), "baseUrl")
    shown = writes.without_snapshot(spark.createDataFrame([(1, "x"), (2, "y")], "id int, html string"), spark.createDataFrame([(2,), (2,)], "id int"))
    assert {r.id: r.html for r in shown.collect()} == {1: "x", 2: None}


def test_report_is_written(spark, sf, tmp_path):
    a = derived_archive(spark, sf)
    plugins = analyzers.load({"analyze-rules": True})
    html = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("id"), "html")
    found = commands.analyze(a["pages"].join(html, "id"), plugins)
    commands.write_report(found, f"{tmp_path}/found")
    again = commands.plugin_reports(spark, f"{tmp_path}/found")
    assert set(again) == {"cells", "violations", "errors"} and commands.plugin_reports(spark, f"{tmp_path}/none") == {}
    sheets = commands.report(a, ["page_list", "links", "violations"], again, ["rules"])
    commands.write_report(sheets, f"{tmp_path}/sheets", "csv")
    listed = spark.read.option("header", True).csv(f"{tmp_path}/sheets/page_list")
    assert listed.columns[-1] == "rules" and listed.filter("rules IS NOT NULL").count() > 0
    commands.write_diff(a["pages"], a["pages"].filter("id % 2 = 0"), f"{tmp_path}/diff")
    assert spark.read.text(f"{tmp_path}/diff/a").count() > spark.read.text(f"{tmp_path}/diff/b").count() > 0


def test_search_below_a_scope(spark):
    page = "<nav>menu word</nav><main><p>word and word</p><p>word</p></main>"
    plugin = analyzers.search({"scope": "main", "keywords": ["word", "word", {"search": "w", "title": "and"}], "selectors": ["nav", "table", "a:::"]})
    assert plugin.each_page("u", page) == ([("keyword:word", 2, None), ("keyword:and", 1, None), ("selector:nav", True, None)], [])
    assert plugin.headers["keyword:w"] == "Search keyword: w" and plugin.each_page("u", "<p>word</p>") is None


def test_resource_events(spark):
    rows = spark.createDataFrame([("r#1", "p"), ("r", "q"), ("s", "p")], "url string, pageUrl string")
    resources, referrers = frontier.resource_events(rows)
    assert sorted(r.url for r in resources.collect()) == ["r", "s"]
    assert sorted(tuple(r) for r in referrers.collect()) == [("r", "p"), ("r", "q"), ("s", "p")]
