"""Read queries over the archive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators.writes import url_order
from siteloom.sources.archive import FLAGS, META

HTML = "text/html"


def page_filter(name: str | None) -> Column:
    """The eight named page filters. The type is compared exactly, without trimming or folding."""
    ct = F.col("contentType")
    is_html, other = ct == HTML, ct.isNull() | (ct != HTML)
    return {
        None: F.lit(True),
        "page": is_html & (F.col("isTarget") == 1),
        "page-included-no-target": is_html,
        "external-page": is_html & (F.col("isExternal") == 1),
        "internal-page": is_html & (F.col("isExternal") == 0),
        "no-page": other,
        "external-no-page": other & (F.col("isExternal") == 1),
        "internal-no-page": other & (F.col("isExternal") == 0),
    }[name]


def pages(table: DataFrame, kind: str | None = None) -> DataFrame:
    return table.filter(page_filter(kind))


def page_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("id").alias("n"))


def crawling_state(table: DataFrame) -> DataFrame:
    return table.select("url", F.when(F.col("scraped") == 1, "scraped").otherwise("pending").alias("state"))


def anchors_on_pages(anchors: DataFrame, table: DataFrame) -> DataFrame:
    """Anchors with what they point at; redirects are not followed."""
    dest = table.select(F.col("id").alias("hrefId"), "url", "title", "status", "statusText", "contentType")
    return anchors.join(dest, "hrefId").select("pageId", "url", "title", "status", "statusText", "contentType", "hash", "textContent")


def referrers_of_pages(anchors: DataFrame, table: DataFrame) -> DataFrame:
    source = table.select(F.col("id").alias("pageId"), "url")
    return anchors.join(source, "pageId").select(F.col("hrefId").alias("id"), "url", "hash", "textContent")


def referrers_of_resources(links: DataFrame, resources: DataFrame, table: DataFrame) -> DataFrame:
    known = resources.select(F.col("id").alias("resourceId"))
    return links.join(known, "resourceId").join(table.select(F.col("id").alias("pageId"), "url"), "pageId").select("resourceId", "url")


def redirects_for_pages(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages that redirect to one of ids (column id)."""
    out = table.select(F.col("redirectDestId").alias("pageId"), F.col("url").alias("from"), F.col("id").alias("fromId"))
    return out.join(ids.select(F.col("id").alias("pageId")), "pageId", "left_semi").select("pageId", "from", "fromId")


def redirect_map(table: DataFrame, identity: bool = True) -> DataFrame:
    """fromId, from, to, toId over one hop; a redirect to a missing page drops out. The two arms are disjoint."""
    dest = table.select(F.col("id").alias("toId"), F.col("url").alias("to"))
    hops = table.select(F.col("id").alias("fromId"), F.col("url").alias("from"), F.col("redirectDestId").alias("toId")).join(dest, "toId")
    hops = hops.select("fromId", "from", "to", "toId")
    if not identity:
        return hops
    own = table.filter("redirectDestId IS NULL")
    return hops.union(own.select("id", "url", "url", "id"))


def with_order(table: DataFrame) -> DataFrame:
    """Internal pages numbered in natural order of their addresses, by ranges; external ones have no order."""
    return url_order(table, urls.natural_key(F.col("url"))).withColumn("order", F.col("order").cast("int"))


def page_ids(table: DataFrame) -> DataFrame:
    """Ids of pages that are no redirects, where no order is asked for."""
    return table.filter("redirectDestId IS NULL").select("id")


def limited_page_ids(ordered: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    out = ordered.filter("redirectDestId IS NULL").select("id", "order")
    if limit is not None:
        out = out.orderBy(F.col("order").asc_nulls_last(), "id").offset(offset).limit(limit)
    return out


def rel_redirects(table: DataFrame, limited: DataFrame) -> DataFrame:
    hops = redirect_map(table, identity=False)
    return hops.join(limited.select(F.col("id").alias("toId")), "toId").select(F.col("toId").alias("pageId"), "from", "fromId")


def rel_anchors(anchors: DataFrame, table: DataFrame, limited: DataFrame) -> DataFrame:
    """Anchors of the limited pages through one redirect: url is where they end, href what they say."""
    m = redirect_map(table).select(F.col("fromId").alias("hrefId"), F.col("from").alias("href"), "toId")
    dest = table.select(F.col("id").alias("toId"), "url", "isExternal", "title", "status", "statusText", "contentType")
    own = limited.select(F.col("id").alias("pageId"))
    return (
        anchors.join(own, "pageId").join(m, "hrefId").join(dest, "toId")
        .select("id", "pageId", "url", "href", "isExternal", "title", "status", "statusText", "contentType", "hash", "textContent")
    )


def rel_referrers(anchors: DataFrame, table: DataFrame, limited: DataFrame) -> DataFrame:
    m = redirect_map(table).select(F.col("fromId").alias("hrefId"), F.col("from").alias("through"), "toId")
    source = table.select(F.col("id").alias("pageId"), "url")
    to = limited.select(F.col("id").alias("toId"))
    return (
        anchors.join(m, "hrefId").join(to, "toId").join(source, "pageId")
        .select("id", F.col("toId").alias("pageId"), "url", "through", F.col("hrefId").alias("throughId"), "hash", "textContent")
    )


def pages_with_redirects(table: DataFrame, kind: str) -> DataFrame:
    """Pages of a filter with their redirect sources as one sorted array."""
    hops = redirect_map(table, identity=False).groupBy(F.col("toId").alias("id")).agg(F.array_sort(F.collect_list(F.struct("fromId", "from"))).alias("redirectFrom"))
    return pages(table, kind).join(hops, "id", "left")


def parsed_headers(table: DataFrame) -> DataFrame:
    """Response headers as a map; text that is no JSON object gives an empty map."""
    headers = F.from_json("responseHeaders", "map<string,string>")
    return table.withColumn("headers", F.coalesce(headers, F.from_json(F.lit("{}"), "map<string,string>")))


def is_page() -> Column:
    """As a page object says it: trimmed and folded, unlike the filters."""
    return F.coalesce(F.lower(F.trim("contentType")) == HTML, F.lit(False))


def is_internal_page() -> Column:
    return is_page() & (F.coalesce(F.col("isExternal"), F.lit(0)) == 0)


def page_rows(table: DataFrame) -> DataFrame:
    """A page's own fields with the defaults of its object form."""
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    return parsed_headers(table).select(
        "id", "url", F.coalesce("title", F.lit("")).alias("title"), "status", "statusText", "contentType", "contentLength", F.col("headers").alias("responseHeaders"),
        flag("isExternal"), flag("isSkipped"), "skipReason", flag("isTarget"), "lang", *META, *map(flag, FLAGS), is_page().alias("isPage"), is_internal_page().alias("isInternalPage"),
    )


def grouped_relations(anchors: DataFrame, table: DataFrame, limited: DataFrame) -> DataFrame:
    """id with the arrays redirectFrom (by id), anchors and referrers (by anchor id) of the limited pages; empty where there are none."""

    def grouped(rows: DataFrame, name: str, key: str, fields: list[str]) -> DataFrame:
        return rows.groupBy(F.col("pageId").alias("id")).agg(F.array_sort(F.collect_list(F.struct(key, *fields))).alias(name))

    hops = grouped(rel_redirects(table, limited), "redirectFrom", "fromId", ["from"])
    links = grouped(rel_anchors(anchors, table, limited), "anchors", "id", ["url", "href", "isExternal", "title", "status", "statusText", "contentType", "hash", "textContent"])
    refs = rel_referrers(anchors, table, limited).withColumn("textContent", F.coalesce("textContent", F.lit("")))
    refs = grouped(refs, "referrers", "id", ["url", "through", "throughId", "hash", "textContent"])
    out = limited.select("id").join(hops, "id", "left").join(links, "id", "left").join(refs, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.array()) for c in ("redirectFrom", "anchors", "referrers")})


def pages_with_refs(anchors: DataFrame, table: DataFrame, with_refs: bool = True) -> DataFrame:
    """Pages with their relations; without them, the internal pages as they are."""
    if not with_refs:
        return pages(table, "internal-page")
    return page_rows(table.filter("redirectDestId IS NULL")).join(grouped_relations(anchors, table, page_ids(table)), "id")


def page_json(anchors: DataFrame, table: DataFrame) -> DataFrame:
    """A page's 31 fields as JSON: its own, where it was redirected from, its anchors and referrers."""
    rows = pages_with_refs(anchors, table).withColumnsRenamed({"anchors": "getAnchors", "referrers": "getReferrers"})
    return rows.select("id", F.to_json(F.struct(*[c for c in rows.columns if c != "id"]), {"ignoreNullFields": "false"}).alias("json"))


def resource_urls(resources: DataFrame) -> DataFrame:
    return resources.select("url")


def html_of(table: DataFrame) -> DataFrame:
    return table.select("id", F.nullif("html", F.lit("")).alias("html"))


def one_value(info: DataFrame, column: str):
    """baseUrl or name of the archive; an error if it has no configuration."""
    row = info.select(column).first()
    if row is None:
        raise ValueError(f"the archive has no {column}")
    return row[0]


def json_list(column: Column) -> Column:
    """A JSON list of texts; anything else is an empty one."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def config(info: DataFrame) -> DataFrame:
    """The configuration row: JSON lists that cannot be read are empty, retry defaults to 3."""
    lists = {c: json_list(F.col(c)) for c in ("scope", "excludes", "excludeKeywords", "excludeUrls") if c in info.columns}
    out = info.withColumns(lists)
    return out.withColumn("retry", F.coalesce("retry", F.lit(3))) if "retry" in info.columns else out


def config_row(options: DataFrame) -> DataFrame:
    """The inverse of config(): lists as JSON text."""
    return options.withColumns({c: F.to_json(c) for c, kind in options.dtypes if kind == "array<string>"})
