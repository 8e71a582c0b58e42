"""Report views over the archive: page list, links, resources, violations, discrepancies and the relation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators import reads

NO_TEXT = "__NO_TEXT_CONTENT__"
#: The page list's columns and their headers.
PAGE_LIST = {
    "title": "Title", "fullTitle": "Full Title", "url": "URL", "protocol": "Protocol", "domain": "Domain",
    "path1": "path1", "path2": "path2", "path3": "path3", "path4": "path4", "path5": "path5",
    "path6": "path6", "path7": "path7", "path8": "path8", "path9": "path9", "path10": "path10",
    "status": "Status Code", "redirects": "Redirect From", "lang": "Language",
    "iLinks": "Internal Links", "iBad": "Internal Bad Links", "xLinks": "External Links", "xBad": "External Bad Links", "referrers": "Internal Referrers",
    "description": "description", "keywords": "keywords", "noindex": "noindex", "nofollow": "nofollow", "noarchive": "noarchive",
    "canonical": "canonical", "alternate": "alternate", "twitter_card": "twitter:card", "og_site_name": "og:site_name", "og_url": "og:url",
    "og_title": "og:title", "og_description": "og:description", "og_type": "og:type", "og_image": "og:image",
}
#: What marks a page address or title as suspicious.
ODD_PATH = r"(?i)(^/_|_$|_copy|-copy|copy_|copy-|dummy)"
ERROR_TITLE = r"(?i)(^| )(401|403|404|500|501|502|503)"


def _joined(value: Column, order: Column) -> Column:
    """Lines in the order of `order`."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), "\n")


def bad_link(status: Column) -> Column:
    """No status or 0, or 400 and above but for 401; -1 is not bad."""
    return F.coalesce(status == 0, F.lit(True)) | ((status >= 400) & (status != 401))


def link_quality(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """pageId with counts of internal and external links and bad ones, and lines naming the bad."""
    rel = reads.rel_anchors(anchors, pages, reads.page_ids(pages))
    ext, bad = F.col("isExternal") == 1, bad_link(F.col("status"))
    shown = F.when(F.col("href") == F.col("url"), F.col("url")).otherwise(F.concat("href", F.lit(" => "), "url"))
    line = F.concat(F.coalesce("textContent", F.lit("null")), F.lit(" ("), F.coalesce(F.col("status").cast("string"), F.lit("null")), F.lit(" "), F.coalesce("statusText", F.lit("null")), F.lit(" "), shown, F.lit(")"))
    n = lambda c: F.sum(c.cast("long"))
    rows = F.array_sort(F.collect_list(F.when(bad, F.struct(F.col("id").alias("o"), ext.alias("x"), line.alias("v")))))
    text = lambda x: F.array_join(F.transform(F.filter("rows", lambda r: r["x"] == x), lambda r: r["v"]), "\n")
    out = rel.groupBy("pageId").agg(n(~ext).alias("iLinks"), n(ext).alias("xLinks"), n(~ext & bad).alias("iBad"), n(ext & bad).alias("xBad"), rows.alias("rows"))
    return out.select("pageId", "iLinks", "xLinks", "iBad", "xBad", text(False).alias("iBadNote"), text(True).alias("xBadNote"))


def path_columns(pages: DataFrame) -> DataFrame:
    """path1 to path10: decoded segments with '/', the last with its query."""
    u = F.col("url")
    p, q = urls.paths(u), urls.query(u)
    last = F.size(p)
    cell = lambda i: F.when(i <= last, F.concat(F.lit("/"), urls.decode_safely(F.concat(F.get(p, F.lit(i - 1)), F.when((last == i) & (q != ""), F.concat(F.lit("?"), q)).otherwise("")))))
    return pages.select("id", *[cell(i).alias(f"path{i}") for i in range(1, 11)], last.alias("depth"))


def listed(ordered: DataFrame) -> DataFrame:
    """The pages that the page list shows: internal targets that are pages and no redirects."""
    return ordered.filter("redirectDestId IS NULL").filter((F.col("isExternal") == 0) & (F.col("isTarget") == 1) & reads.is_page())


def short_titles(pages: DataFrame) -> DataFrame:
    """Titles without that of the index page last seen for the directory, or its parent; the order of pages is `order`, id.

    Look-ups and definitions are united by directory of a host; the last definition before a look-up is a window over each.
    """
    u = F.col("url")
    p = urls.paths(u)
    base = pages.select("id", "order", "title", urls.is_index(u).alias("ix"), F.concat(urls.host(u), urls.dirname(u)).alias("dir"), F.concat(urls.host(u), F.lit("/"), F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 2, F.lit(0))), "/")).alias("up"))
    none = F.lit(None).cast("string")
    ask = lambda key, which: base.select("id", "order", F.col(key).alias("key"), F.lit(which).alias("which"), none.alias("given"))
    define = base.filter("ix").select("id", "order", F.col("dir").alias("key"), F.lit(2).alias("which"), F.col("title").alias("given"))
    w = Window.partitionBy("key").orderBy(F.col("order").asc_nulls_last(), "id", "which").rowsBetween(Window.unboundedPreceding, -1)
    rows = ask("dir", 0).union(ask("up", 1)).union(define).withColumn("t", F.nullif(F.last("given", ignorenulls=True).over(w), F.lit("")))
    found = rows.filter("which < 2").groupBy("id").agg(F.max(F.when(F.col("which") == 0, F.col("t"))).alias("own"), F.max(F.when(F.col("which") == 1, F.col("t"))).alias("parent"))
    out = base.join(found, "id").withColumn("cut", F.when(F.col("ix"), F.coalesce("parent", "own")).otherwise(F.coalesce("own", "parent")))
    at = F.instr(F.col("title"), F.col("cut"))
    rest = F.concat(F.substring(F.col("title"), F.lit(1), at - 1), F.substring(F.col("title"), at + F.length("cut"), F.length("title")))
    short = F.trim(F.regexp_replace(rest, "[|｜]", ""))
    return out.select("id", F.when(F.col("cut").isNotNull() & (at > 0) & (short != ""), short).otherwise(F.col("title")).alias("title"))


def index_referrers(anchors: DataFrame, pages: DataFrame, limited: DataFrame) -> DataFrame:
    """Referrer counts of the listed pages; index pages after the first of a directory of a host show the directory's total."""
    counts = reads.rel_referrers(anchors, pages, limited.select("id")).groupBy("pageId").agg(F.count("*").alias("n"))
    u = F.col("url")
    rows = limited.select("id", "order", urls.is_index(u).alias("ix"), F.concat(urls.host(u), urls.dirname(u)).alias("dir")).join(counts.withColumnRenamed("pageId", "id"), "id", "left")
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0)))
    # only index pages meet in a window; other pages are their own groups
    group = F.when(F.col("ix"), F.col("dir")).otherwise(F.concat(F.lit("#"), F.col("id")))
    own = Window.partitionBy("g")
    first = F.row_number().over(own.orderBy(F.col("order").asc_nulls_last(), "id")) == 1
    return rows.withColumn("g", group).select("id", F.when(first, F.col("n")).otherwise(F.sum("n").over(own)).cast("long").alias("referrers"))


def redirect_from(pages: DataFrame) -> DataFrame:
    hops = reads.redirect_map(pages, identity=False)
    return hops.groupBy(F.col("toId").alias("id")).agg(F.count("*").alias("redirects"), _joined(F.col("from"), F.col("fromId")).alias("redirectNote"))


def page_list(anchors: DataFrame, pages: DataFrame, cells: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Internal target pages: the 37 columns of PAGE_LIST with their notes. cells: merged plugin cells, of which `columns` follow."""
    base = listed(reads.with_order(pages))
    u = F.col("url")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    own = base.select(
        "id", "order", "url", text("title").alias("fullTitle"), F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1).alias("protocol"), urls.host(u).alias("domain"),
        F.coalesce(F.nullif("status", F.lit(0)), F.lit(-1)).alias("status"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("N/A")).alias("lang"),
        *map(text, reads.META), *[F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in reads.FLAGS],
    )
    parts = [
        path_columns(base).drop("depth"), short_titles(base), link_quality(anchors, pages).withColumnRenamed("pageId", "id"),
        index_referrers(anchors, pages, base), redirect_from(pages),
    ]
    out = own
    for part in parts:
        out = out.join(part, "id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("iLinks", "xLinks", "iBad", "xBad", "referrers", "redirects")}
    out = out.withColumns(zero | {c: F.coalesce(c, F.lit("")) for c in ("iBadNote", "xBadNote", "redirectNote")})
    out = out.select("id", "order", *PAGE_LIST, "redirectNote", "iBadNote", "xBadNote")
    if cells is None:
        return out
    wide = cells.groupBy("url").pivot("col", columns).agg(F.first("value"))
    return out.join(wide, "url", "left").select(*out.columns, *columns)


def max_depth(pages: DataFrame) -> DataFrame:
    """Of the listed pages."""
    return listed(pages).agg(F.max(urls.depth(F.col("url"))).alias("max_depth"))


def links(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    whole = reads.parsed_headers(pages).filter("redirectDestId IS NULL")
    rel = reads.rel_referrers(anchors, pages, whole.select("id")).join(whole.select(F.col("id").alias("pageId"), F.col("url").alias("pageUrl")), "pageId")
    where = F.concat("url", F.coalesce(F.concat(F.lit("#"), "hash"), F.lit("")))
    via = F.when(F.col("pageUrl") == F.col("through"), "").otherwise(F.concat(F.lit(" => [REDIRECTED FROM] "), "through"))
    line = F.concat(F.coalesce(F.nullif("textContent", F.lit("")), F.lit(NO_TEXT)), F.lit(" ("), where, via, F.lit(")"))
    refs = rel.groupBy(F.col("pageId").alias("id")).agg(F.count("*").alias("n"), _joined(line, F.col("id")).alias("referrerNote"))
    out = whole.join(refs, "id", "left").join(redirect_from(pages), "id", "left")
    return out.select(
        "id", "url", F.coalesce(F.nullif("title", F.lit("")), F.lit("-")).alias("title"), F.coalesce(F.nullif("status", F.lit(0)), F.lit(-1)).alias("status"),
        F.coalesce("statusText", F.lit("")).alias("statusText"),
        F.coalesce("contentType", F.lit("")).alias("contentType"), F.coalesce("redirects", F.lit(0)).alias("redirects"), F.coalesce("redirectNote", F.lit("")).alias("redirectNote"),
        F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" Elements")).alias("referrers"), F.coalesce("referrerNote", F.lit("")).alias("referrerNote"),
        F.to_json("headers").alias("headers"), F.when(F.col("isSkipped") == 1, F.coalesce(F.nullif("skipReason", F.lit("")), F.lit("skipped"))).otherwise("").alias("remarks"),
    )


def resources(table: DataFrame, links_: DataFrame, pages: DataFrame) -> DataFrame:
    refs = reads.referrers_of_resources(links_, table, pages).groupBy(F.col("resourceId").alias("id")).agg(F.count("*").alias("n"), _joined(F.col("url"), F.col("url")).alias("note"))
    out = table.join(refs, "id", "left")
    return out.select("id", "url", "status", "contentType", F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" pages")).alias("referrers"), F.coalesce("note", F.lit("")).alias("note"))


def images(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """Every image of internal HTML pages. parsed: (id, images)."""
    own = pages.filter(reads.is_internal_page()).select("id", "url")
    return parsed.select("id", F.posexplode("images").alias("pos", "i")).join(own, "id").select("id", "url", "pos", "i.*")


def violations(reports: DataFrame) -> DataFrame:
    """reports: (name, violations array)."""
    return reports.select(F.explode("violations").alias("v")).select("v.validator", "v.severity", "v.rule", "v.code", "v.message", "v.url")


def discrepancies(anchors: DataFrame, pages: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Link text against the title of where it ends; plugin rows have five cells and so stand one column to the left."""
    rel = reads.rel_anchors(anchors, pages, reads.page_ids(pages))
    left = pages.select(F.col("id").alias("pageId"), F.col("url").alias("leftUrl"))
    own = rel.join(left, "pageId").select(F.lit("Link Text vs Page Title").alias("type"), "leftUrl", F.col("textContent").alias("left"), F.col("title").alias("right"), F.col("url").alias("rightUrl"), F.lit("").alias("note"))
    if reports is None:
        return own
    d = reports.select(F.explode("discrepancies").alias("d")).select("d.leftSourceUrl", "d.left", "d.right", "d.rightSourceUrl", "d.note", F.lit(None).cast("string"))
    return own.union(d)


def referrers_relational(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each page and anchor that leads to it, through a redirect or not."""
    limited = pages.filter("redirectDestId IS NULL").select("id", F.col("url").alias("link"))
    rel = reads.rel_referrers(anchors, pages, limited.select("id"))
    target = limited.select(F.col("id").alias("pageId"), "link")
    where = F.concat("url", F.coalesce(F.concat(F.lit("#"), F.nullif("hash", F.lit(""))), F.lit("")))
    return rel.join(target, "pageId").select("link", where.alias("referrer"), F.coalesce(F.nullif("textContent", F.lit("")), F.lit(NO_TEXT)).alias("content"), "through")


def resources_relational(table: DataFrame, links_: DataFrame, pages: DataFrame) -> DataFrame:
    rel = reads.referrers_of_resources(links_, table, pages).select(F.col("resourceId").alias("id"), F.col("url").alias("page"))
    return table.select("id", "url", "status", "contentType").join(rel, "id").select("url", "status", "contentType", "page")


def page_flags(rows: DataFrame) -> DataFrame:
    """rows of page_list(): which cells are marked."""
    path = urls.pathname(F.col("url"))
    return rows.select(
        "id", ((F.col("iBad") != 0) | (F.col("xBad") != 0)).alias("badLinks"), (F.col("lang") == "N/A").alias("noLang"), (F.col("referrers") < 2).alias("fewReferrers"),
        path.rlike(ODD_PATH).alias("oddPath"), F.col("title").rlike(ERROR_TITLE).alias("errorTitle"), F.col("url").startswith("http:").alias("plainHttp"),
        ((F.col("status") < 200) | (F.col("status") > 399)).alias("badStatus"),
    )


def link_flags(rows: DataFrame) -> DataFrame:
    return rows.select("id", (F.col("status") >= 400).alias("failed"), (F.col("remarks") != "").alias("skipped"))
