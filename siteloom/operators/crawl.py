"""The crawl as rounds of joins over a given corpus, and the decisions taken in it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls


@dataclass
class CrawlConfig:
    """Options of a crawl with their defaults; maxExcludedDepth and imageFileSizeThreshold are kept but decide nothing."""

    recursive: bool = True
    fetchExternal: bool = True
    image: bool = True
    parallels: int = 10
    interval: int = 0
    retry: int = 3
    maxExcludedDepth: int = 10
    imageFileSizeThreshold: int | None = None
    disableQueries: bool = False
    ignoreRobots: bool = False
    userAgent: str = "siteloom/1"
    scope: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    excludeKeywords: list[str] = field(default_factory=list)
    excludeUrls: list[str] = field(default_factory=list)

    def merged(self, overrides: dict) -> CrawlConfig:
        """Stored options with those of overrides that are set."""
        return CrawlConfig(**(self.__dict__ | {k: v for k, v in overrides.items() if v is not None}))


def is_error(status: Column) -> Column:
    return F.coalesce((status < 200) | (status > 399), F.lit(True))


def decision(url: Column, robots: Column, excluded: Column, external: Column, fetch_external: bool) -> Column:
    """action and reason, the first that holds: robots, exclusion, external addresses that are not fetched."""
    make = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).cast("string").alias("reason"))
    return (
        F.when(~robots, make("skip", "robots")).when(excluded, make("skip", "excluded"))
        .when(external & F.lit(not fetch_external), make("skip", "external")).otherwise(make("fetch", None))
    )


def fetch_mode(url: Column, head_status: Column, content_type: Column, metadata_only: Column) -> Column:
    """How a page would be fetched: browser, title, head or error."""
    html = content_type.isNull() | (content_type == "text/html")
    return F.when(~url.rlike("^https?:"), "browser").when(head_status.isNull(), "error").when(metadata_only & html, "title").when(~html, "head").otherwise("browser")


def follow_mode(external: Column, lower: Column, config: CrawlConfig) -> Column:
    """full, metadata, or null where the link is not followed."""
    if not config.recursive:
        return F.lit("metadata")
    return F.when(~external & lower, "full").when(external & F.lit(config.fetchExternal), "metadata")


def is_page_link(external: Column, lower: Column, url: Column, status: Column, content_type: Column) -> Column:
    good = ~external & lower & url.rlike("^https?:") & ~is_error(status) & (content_type == "text/html")
    return F.coalesce(good, F.lit(False))


def link_counts(links: DataFrame) -> DataFrame:
    """links (done, isPage, hops): a finished page counts once and once more for each hop of its redirects."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    done_page = F.col("done") & F.col("isPage")
    return links.agg(
        F.count("*").alias("totalLinks"), n(F.col("done"))("completedLinks"), n(F.col("isPage"))("totalPages"),
        F.coalesce(F.sum(F.when(done_page, 1 + F.col("hops"))), F.lit(0)).cast("long").alias("completedPages"),
    )


def page_data(links: DataFrame) -> DataFrame:
    """Defaults of a page that was only looked up."""
    return links.withColumns({
        "status": F.coalesce(F.nullif("status", F.lit(0)), F.lit(-1)), "statusText": F.coalesce(F.nullif("statusText", F.lit("")), F.lit("UnknownError")),
        "contentLength": F.nullif("contentLength", F.lit(0)), "title": F.coalesce("title", F.lit("")),
    })


def js_number(token: Column) -> Column:
    """A token as JavaScript reads a number: blank is 0, hexadecimal and exponents count; null for none."""
    t = F.trim(token)
    plain = F.when(t.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    hexa = F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 20), 16, 10).cast("double"))
    return F.when(t == "", 0.0).otherwise(F.coalesce(plain, hexa))


def pagination(prev: Column, cur: Column) -> Column:
    """tokenIndex, step and currentNumber if exactly one token differs, by whole numbers that grow; else null."""
    a, b = urls.decomposed(prev), urls.decomposed(cur)
    left, right = F.concat(a["pathSegments"], a["queryValues"]), F.concat(b["pathSegments"], b["queryValues"])
    alike = (a["host"] == b["host"]) & (F.size(a["pathSegments"]) == F.size(b["pathSegments"])) & (a["queryKeys"] == b["queryKeys"])
    differ = F.filter(F.sequence(F.lit(0), F.greatest(F.size(left) - 1, F.lit(0))), lambda i: F.get(left, i) != F.get(right, i))
    at = F.get(differ, F.lit(0))
    m, n = js_number(F.get(left, at)), js_number(F.get(right, at))
    found = F.struct(at.cast("int").alias("tokenIndex"), (n - m).cast("long").alias("step"), n.cast("long").alias("currentNumber"))
    return F.when(alike & (F.size(differ) == 1) & (m == F.floor(m)) & (n == F.floor(n)) & (n > m), found)


def predicted(rows: DataFrame, count: int) -> DataFrame:
    """rows (url, pattern) with `predicted`: the next `count` addresses of each pattern."""
    i = F.explode(F.sequence(F.lit(1), F.lit(count)))
    value = (F.col("pattern.currentNumber") + F.col("pattern.step") * F.col("i")).cast("string")
    return rows.filter("pattern IS NOT NULL").withColumn("i", i).withColumn("predicted", urls.reconstructed(urls.decomposed(F.col("url")), F.col("pattern.tokenIndex"), value))


def accepted_patterns(pushes: DataFrame, by: str = "crawl") -> DataFrame:
    """pushes (crawl, seq, url, full) with `pattern` where one is accepted.

    A push compares with the one before, unless that one was itself detected; links that are not followed in full are
    not compared and start anew. So in a run of candidates every second one is accepted, counted from its first.
    """
    w = Window.partitionBy(by).orderBy("seq")
    seen = pushes.withColumns({"prev": F.lag("url").over(w), "prev_full": F.lag("full").over(w)})
    seen = seen.withColumn("candidate", F.when(F.col("full") & F.col("prev_full"), pagination(F.col("prev"), F.col("url"))))
    seen = seen.withColumn("run", F.sum(F.when(F.col("candidate").isNull(), 1).otherwise(0)).over(w))
    place = F.row_number().over(Window.partitionBy(by, "run").orderBy("seq"))
    rank = place - F.when(F.first("candidate").over(Window.partitionBy(by, "run").orderBy("seq")).isNull(), 1).otherwise(0)
    return seen.withColumn("pattern", F.when(F.col("candidate").isNotNull() & (rank % 2 == 1), F.col("candidate"))).select(*pushes.columns, "pattern")


def kept_predictions(rows: DataFrame) -> DataFrame:
    """Results of predicted addresses that stay: no error, not skipped, with page data and a good status."""
    return rows.filter(~F.coalesce("failed", F.lit(False)) & ~F.coalesce("skipped", F.lit(False)) & F.col("status").isNotNull() & ~is_error(F.col("status")))


def first_of_keys(frontier: DataFrame) -> DataFrame:
    """The frontier without addresses that differ only in scheme, user data or fragment; the first by seq stays."""
    keyed = frontier.withColumn("key", urls.protocol_key(urls.without_hash_and_auth(F.col("url"))))
    w = Window.partitionBy("key").orderBy("seq")
    return keyed.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def reachable(start: DataFrame, edges: DataFrame, keep, max_rounds: int | None = None) -> DataFrame:
    """Breadth-first rounds: (id, round) of everything reached from start (id) over edges (src, dst); keep cuts lineage.

    keep(df) writes a round's rows to shared storage and reads them again. A round joins only its own frontier.
    """
    seen = keep(start.select("id").distinct().withColumn("round", F.lit(0)))
    frontier, n = seen, 0
    while max_rounds is None or n < max_rounds:
        n += 1
        found = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = keep(found.join(seen, "id", "left_anti").withColumn("round", F.lit(n)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def archive_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Active internal pages (html, status 200 to 399) of two archives: url and the side that has it."""
    active = lambda t: t.filter((F.lower(F.trim("contentType")) == "text/html") & (F.col("isExternal") == 0) & F.col("status").between(200, 399)).select("url").distinct()
    x, y = active(a).withColumn("in_a", F.lit(True)), active(b).withColumn("in_b", F.lit(True))
    return x.join(y, "url", "full_outer").select("url", F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a").otherwise("b").alias("side"))
