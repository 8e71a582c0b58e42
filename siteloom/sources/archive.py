"""The archive: six tables as Parquet, and the archive that the test corpus stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text fields of a page's head.
META = ("description", "keywords", "canonical", "alternate", "og_type", "og_title", "og_site_name", "og_description", "og_url", "og_image", "twitter_card")
FLAGS = ("noindex", "nofollow", "noarchive")
TABLES = ("info", "pages", "anchors", "images", "resources", "resources_referrers")


def read_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The archive's tables that exist under path."""
    return read_tables(spark, path, TABLES)


def read_tables(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Of the named tables those that exist under path."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda t: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{t}"))
    return {t: spark.read.parquet(f"{path}/{t}") for t in names if there(t)}


def write_archive(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a list file: trimmed lines, blank ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def derived_archive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """An archive computed from the corpus tables; every column is a rule of page_id, so results can be checked in SQL."""
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n = raw.count()
    i = F.col("page_id")
    host = F.regexp_extract("url", "^https?://([^/?#:]+)", 1)
    pages = raw.select(
        i.alias("id"),
        F.regexp_replace("url", "#.*$", "").alias("url"),
        F.when(i % 10 == 9, i - 1).alias("redirectDestId"),
        F.lit(1).alias("scraped"),
        F.when(i % 10 == 9, 0).otherwise(1).alias("isTarget"),
        F.when(host.like("%.example.com"), 0).otherwise(1).alias("isExternal"),
        F.when(i % 20 == 3, 404).when(i % 20 == 7, 500).when(i % 20 == 11, 401).when(i % 20 == 13, F.lit(None)).when(i % 20 == 17, -1).otherwise(200).alias("status"),
        F.when(i % 25 == 4, F.lit(None)).when(i % 25 == 6, "application/json").when(i % 25 == 8, " Text/HTML ").otherwise("text/html").alias("contentType"),
        F.when(i % 30 == 14, 1).when(i % 30 == 24, 1).otherwise(0).alias("isSkipped"),
        F.when(i % 30 == 14, "excluded").alias("skipReason"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.when(i % 6 != 5, F.regexp_extract("html", '<html lang="([^"]*)"', 1)).alias("lang"),
        F.when(i % 20 == 3, "Not Found").when(i % 20 == 7, "Error").when(i % 20 < 3, "OK").alias("statusText"),
        F.when(i % 4 != 1, i * 10).alias("contentLength"),
        *[F.when(i % (k + 2) == 0, F.concat(F.lit(f"{name} "), i)).alias(name) for k, name in enumerate(META)],
        *[F.when(i % 5 != k, (i % (k + 3) == 0).cast("int")).alias(name) for k, name in enumerate(FLAGS)],
        F.when(i % 7 == 0, '{"server":"x","age":"' + "1" + '"}').when(i % 7 == 1, "{broken").alias("responseHeaders"),
    )
    k = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    anchors = raw.select(i, k).select(
        (i * 5 + F.col("k")).alias("id"),
        i.alias("pageId"),
        ((i * 7 + F.col("k") * 13 + 1) % n).alias("hrefId"),
        F.when(F.col("k") == 2, "top").alias("hash"),
        F.when(F.col("k") != 4, "link").alias("textContent"),
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    resources = part.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("https://cdn.example/"), F.col("p_partkey")).alias("url"),
        (F.col("p_size") % 2).cast("int").alias("isExternal"),
        F.when(F.col("p_size") % 10 != 0, 200).alias("status"),
        F.col("p_type").alias("contentType"),
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    referrers = lines.select(F.col("l_partkey").alias("resourceId"), (F.col("l_orderkey") % n).alias("pageId")).distinct()
    lists = {"scope": ["https://a.example.com/", "https://b.example.com/x"], "excludes": ["/x/*"], "excludeKeywords": [], "excludeUrls": None}
    info = spark.range(1).select(
        "id", F.lit("1.0").alias("version"), F.lit("crawl").alias("name"), F.lit("https://a.example.com").alias("baseUrl"), F.lit(None).cast("int").alias("retry"),
        *[(F.array(*map(F.lit, v)).cast("array<string>") if v is not None else F.lit(None).cast("array<string>")).alias(c) for c, v in lists.items()],
    )
    images = raw.select(
        (i * 2).alias("id"), i.alias("pageId"), F.concat(F.lit("/i"), i, F.lit(".png")).alias("src"), F.lit("").alias("currentSrc"), F.lit("a").alias("alt"),
        F.lit(10.0).alias("width"), F.lit(20.0).alias("height"), (i % 2 == 0).alias("isLazy"), F.lit("<img>").alias("sourceCode"),
    )
    return {"info": info, "pages": pages, "anchors": anchors, "images": images, "resources": resources, "resources_referrers": referrers}


#: The same archive for DuckDB, as common table expressions.
ARCHIVE_SQL = """
p AS (SELECT page_id AS id, regexp_replace(url, '#.*$', '') AS url, CASE WHEN page_id % 10 = 9 THEN page_id - 1 END AS redirectDestId,
  1 AS scraped, CASE WHEN page_id % 10 = 9 THEN 0 ELSE 1 END AS isTarget,
  CASE WHEN regexp_extract(url, '^https?://([^/?#:]+)', 1) LIKE '%.example.com' THEN 0 ELSE 1 END AS isExternal,
  CASE page_id % 20 WHEN 3 THEN 404 WHEN 7 THEN 500 WHEN 11 THEN 401 WHEN 13 THEN NULL WHEN 17 THEN -1 ELSE 200 END AS status,
  CASE page_id % 25 WHEN 4 THEN NULL WHEN 6 THEN 'application/json' WHEN 8 THEN ' Text/HTML ' ELSE 'text/html' END AS contentType,
  CASE WHEN page_id % 30 IN (14, 24) THEN 1 ELSE 0 END AS isSkipped, CASE WHEN page_id % 30 = 14 THEN 'excluded' END AS skipReason,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE WHEN page_id % 6 <> 5 THEN regexp_extract(html, '<html lang="([^"]*)"', 1) END AS lang,
  CASE WHEN page_id % 20 = 3 THEN 'Not Found' WHEN page_id % 20 = 7 THEN 'Error' WHEN page_id % 20 < 3 THEN 'OK' END AS statusText,
  CASE WHEN page_id % 4 <> 1 THEN page_id * 10 END AS contentLength,
  CASE WHEN page_id % 2 = 0 THEN 'description ' || page_id END AS description,
  CASE WHEN page_id % 3 = 0 THEN 'keywords ' || page_id END AS keywords,
  CASE WHEN page_id % 4 = 0 THEN 'canonical ' || page_id END AS canonical,
  CASE WHEN page_id % 5 = 0 THEN 'alternate ' || page_id END AS alternate,
  CASE WHEN page_id % 6 = 0 THEN 'og_type ' || page_id END AS og_type,
  CASE WHEN page_id % 7 = 0 THEN 'og_title ' || page_id END AS og_title,
  CASE WHEN page_id % 8 = 0 THEN 'og_site_name ' || page_id END AS og_site_name,
  CASE WHEN page_id % 9 = 0 THEN 'og_description ' || page_id END AS og_description,
  CASE WHEN page_id % 10 = 0 THEN 'og_url ' || page_id END AS og_url,
  CASE WHEN page_id % 11 = 0 THEN 'og_image ' || page_id END AS og_image,
  CASE WHEN page_id % 12 = 0 THEN 'twitter_card ' || page_id END AS twitter_card,
  CASE WHEN page_id % 5 <> 0 THEN (page_id % 3 = 0)::INT END AS noindex,
  CASE WHEN page_id % 5 <> 1 THEN (page_id % 4 = 0)::INT END AS nofollow,
  CASE WHEN page_id % 5 <> 2 THEN (page_id % 5 = 0)::INT END AS noarchive,
  CASE page_id % 7 WHEN 0 THEN '{"server":"x","age":"1"}' WHEN 1 THEN '{broken' END AS responseHeaders, html FROM pages),
a AS (SELECT page_id * 5 + k AS id, page_id AS pageId, (page_id * 7 + k * 13 + 1) % (SELECT count(*) FROM pages) AS hrefId,
  CASE WHEN k = 2 THEN 'top' END AS hash, CASE WHEN k <> 4 THEN 'link' END AS textContent FROM pages, range(5) t(k)),
res AS (SELECT p_partkey AS id, 'https://cdn.example/' || p_partkey AS url, (p_size % 2)::INT AS isExternal,
  CASE WHEN p_size % 10 <> 0 THEN 200 END AS status, p_type AS contentType FROM part),
rr AS (SELECT DISTINCT l_partkey AS resourceId, l_orderkey % (SELECT count(*) FROM pages) AS pageId FROM lineitem),
rmap AS (SELECT s.id AS fromId, s.url AS "from", d.url AS "to", d.id AS toId FROM p s JOIN p d ON s.redirectDestId = d.id
  UNION ALL SELECT id, url, url, id FROM p WHERE redirectDestId IS NULL),
nat AS (SELECT id, isExternal, array_to_string(list_transform(regexp_extract_all(regexp_replace(translate(regexp_replace(regexp_replace(url, '^https?:', ''), '/index[.][^/?#]*', '/'), '/', chr(1)),
  '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(len(x)::VARCHAR, 3, '0') || x ELSE x END), '') AS nk FROM p),
ord AS (SELECT id, CASE WHEN isExternal = 0 THEN row_number() OVER (PARTITION BY isExternal ORDER BY nk, id) END AS ord FROM nat)
"""
