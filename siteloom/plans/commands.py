"""The four commands: crawl a corpus, analyze an archive, make its report, or all of it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import pages as html
from siteloom.functions import urls
from siteloom.operators import analyzers, crawl, reads, views
from siteloom.sources.archive import read_tables
from siteloom.sources.scratch import kept


def done(resume: DataFrame) -> DataFrame:
    """Keys of the addresses that a crawl has visited."""
    return resume.filter("scraped = 1").select(urls.protocol_key(urls.without_hash_and_auth(F.col("url"))).alias("key")).distinct()


def crawl_corpus(corpus: DataFrame, links: DataFrame, start: list[str], config: crawl.CrawlConfig, keep, rules: DataFrame | None = None, resume: DataFrame | None = None) -> DataFrame:
    """url, key, mode, round, action and reason of every address found from start over links (url, href, pos) of the corpus.

    Each round joins only its frontier. keep(df) writes a round to shared storage and reads it again. Addresses that differ in
    scheme, user data or fragment are one, also as the pages whose links are followed. resume: addresses (url, scraped) of a
    crawl that is gone on with: scraped ones are not visited again, the others are where it goes on.
    """
    spark = corpus.sparkSession
    scopes = config.scope or start
    hosts = [s.split("//")[1].split("/")[0].split("@")[-1].split(":")[0] for s in scopes if "//" in s]
    u = F.col("url")
    links = links.withColumns({"href": urls.normalized(F.col("href"), config.disableQueries), "from": urls.protocol_key(urls.without_hash_and_auth(urls.normalized(u, config.disableQueries)))})
    if config.excludeKeywords:
        hit = corpus.filter(urls.keyword_excluded(F.col("html"), config.excludeKeywords))
        shut = hit.select(urls.protocol_key(urls.without_hash_and_auth(u)).alias("key")).distinct()
    key = urls.protocol_key(urls.without_hash_and_auth(u))

    def decided(rows: DataFrame) -> DataFrame:
        allowed = rows.withColumn("allowed", F.lit(True))
        if rules is not None and not config.ignoreRobots:
            allowed = urls.robots_allowed(rows, rules)
        skip = urls.should_skip(u, config.excludes, [*urls.DEFAULT_EXCLUDED, *config.excludeUrls])
        d = crawl.decision(u, F.col("allowed"), skip, urls.is_external(u, hosts), config.fetchExternal)
        out = allowed.withColumn("d", d).select("url", "key", "mode", "round", "d.action", "d.reason")
        if config.excludeKeywords:  # a page that holds such a word is read, and neither kept nor followed
            out = out.join(shut.withColumn("shut", F.lit(True)), "key", "left").withColumns({"action": F.when(F.col("shut"), "skip").otherwise(F.col("action")), "reason": F.when(F.col("shut") & F.col("reason").isNull(), "keyword").otherwise(F.col("reason"))})
        return out.select("url", "key", "mode", "round", "action", "reason")

    first = spark.createDataFrame([(s, i) for i, s in enumerate(start)], "url string, seq long")
    if resume is not None:
        first = resume.filter("scraped = 0").select("url", F.xxhash64("url").alias("seq")).union(first.withColumn("seq", F.col("seq") - len(start) - 2**62))
    rows = crawl.first_of_keys(first).select("url", key.alias("key"), F.lit("full").alias("mode"), F.lit(0).alias("round"))
    if resume is not None:
        rows = rows.join(done(resume), "key", "left_anti")
    frontier = keep(decided(rows))
    seen, n = frontier, 0
    while not frontier.isEmpty():
        n += 1
        mode = crawl.follow_mode(urls.is_external(u, hosts), urls.in_any_lower_layer(u, scopes), config)
        live = frontier.filter("action = 'fetch' AND mode = 'full'").select(F.col("key").alias("from"))
        found = links.select("from", F.col("href").alias("url"), "pos").join(live, "from")
        found = found.withColumn("mode", mode).filter("mode IS NOT NULL").withColumn("seq", F.struct("from", "pos"))
        fresh = crawl.first_of_keys(found).join(seen.select("key"), "key", "left_anti")
        if resume is not None:
            fresh = fresh.join(done(resume), "key", "left_anti")
        frontier = keep(decided(fresh.select("url", "key", "mode", F.lit(n).alias("round"))))
        seen = seen.union(frontier)
    return seen


def crawl_list(corpus: DataFrame, links: DataFrame, addresses: list[str], config: crawl.CrawlConfig, keep, rules: DataFrame | None = None) -> DataFrame:
    """The addresses of a list: each is a scope of its own, and links are looked up but not followed."""
    return crawl_corpus(corpus, links, addresses, config.merged({"recursive": False, "scope": addresses}), keep, rules)


def routed(results: DataFrame) -> dict[str, DataFrame]:
    """Results (url, kind, status, error, reason) by what becomes of them: pages, skipped ones, errors with status -1 for an
    unknown host, and predicted ones (column predicted) that were no page, which leave no trace."""
    gone = F.col("predicted") & ((F.col("kind") != "success") | crawl.is_error(F.col("status")))
    live = results.filter(~F.coalesce(gone, F.lit(False)))
    status = F.when(F.col("error").contains("ERR_NAME_NOT_RESOLVED"), -1).otherwise(F.col("status"))
    return {
        "pages": live.filter("kind = 'success'"), "skipped": live.filter("kind = 'skipped'").select("url", "reason"),
        "errors": live.filter("kind = 'error'").withColumn("status", status), "discarded": results.filter(F.coalesce(gone, F.lit(False))).select("url"),
    }


def analyze(pages: DataFrame, plugins: list[analyzers.Analyzer], keep=kept) -> dict[str, DataFrame]:
    """cells, violations and errors of the internal HTML pages; keep(df) writes the one pass over them and reads it again."""
    rows = keep(analyzers.analyze(reads.pages(pages, "internal-page"), plugins))
    return {
        "cells": analyzers.merged(rows),
        "violations": rows.filter("kind = 'violation'").select("validator", "severity", "rule", "code", "message", "url"),
        "errors": rows.filter("kind = 'error'").select("url", F.col("col").alias("plugin"), "message"),
    }


def plugin_reports(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What analyze() left under path; a missing table is left out."""
    return read_tables(spark, path, ("cells", "violations", "errors"))


def report(archive: dict[str, DataFrame], sheets: list[str] | None = None, found: dict[str, DataFrame] | None = None, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """The sheets asked for. found: the tables of analyze(); columns: the plugins' columns of the page list."""
    p, a = archive["pages"], archive["anchors"]
    cells = (found or {}).get("cells")
    made = {
        "page_list": lambda: views.page_list(a, p, cells, columns or []), "links": lambda: views.links(a, p), "discrepancies": lambda: views.discrepancies(a, p),
        "referrers": lambda: views.referrers_relational(a, p), "resources": lambda: views.resources(archive["resources"], archive["resources_referrers"], p),
        "resources_referrers": lambda: views.resources_relational(archive["resources"], archive["resources_referrers"], p),
    }
    if "html" in p.columns:
        made["images"] = lambda: views.images(html.parsed(p.filter(reads.is_internal_page()).filter("html <> ''")), p)
    if found and "violations" in found:
        made["violations"] = lambda: found["violations"]
    return {name: f() for name, f in made.items() if sheets is None or name in sheets}


def write_report(sheets: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Every sheet under path, one folder each; as CSV with a header, nested columns as JSON."""
    for name, df in sheets.items():
        if form == "csv":
            nested = [c for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
            df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        else:
            df.write.mode("overwrite").format(form).save(f"{path}/{name}")


def write_diff(a: DataFrame, b: DataFrame, path: str) -> None:
    """The sorted active addresses of two archives as texts, a and b."""
    sides = crawl.archive_diff(a, b)
    for side in ("a", "b"):
        own = sides.filter(F.col("side").isin(side, "both")).orderBy(urls.natural_key(F.col("url")), "url")
        own.select(F.col("url").alias("value")).write.mode("overwrite").text(f"{path}/{side}")


def output_path(given: str, extension: str, cwd: str | None = None) -> str:
    """The absolute path that a command writes to, with the extension; its folder must exist."""
    path = Path(cwd or Path.cwd(), given)
    if not path.name.endswith(f".{extension}"):
        path = path.with_name(f"{path.name}.{extension}")
    if not path.parent.is_dir():
        raise FileNotFoundError(str(path.parent))
    return str(path)
