"""Upserts into the archive as set operations; `seq` is the order in which records came."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.sources.scratch import kept


def _first(df: DataFrame, key: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def ids_for_urls(known: DataFrame, urls: DataFrame) -> DataFrame:
    """known (id, url) and the new urls among `urls`, numbered on from the greatest id, in the order of a hash.

    Numbers come from a prefix sum over hash buckets, so no task sorts all new addresses.
    """
    fresh = urls.select("url").distinct().join(known, "url", "left_anti").withColumn("h", F.pmod(F.xxhash64("url"), F.lit(1024)))
    sizes = fresh.groupBy("h").count()
    start = sizes.withColumn("start", F.sum("count").over(Window.orderBy("h")) - F.col("count")).drop("count")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    place = F.row_number().over(Window.partitionBy("h").orderBy("url"))
    numbered = fresh.withColumn("n", place).join(start, "h").join(F.broadcast(top))  # top is one row
    return known.select("id", "url").union(numbered.select((F.col("top") + F.col("start") + F.col("n")).cast("long"), "url"))


def latest_pages(records: DataFrame, keep: tuple[str, ...] = ("skipReason", "redirectDestId")) -> DataFrame:
    """One row for each url: the last record's columns, but the last value that is not null for `keep`."""
    held = [c for c in keep if c in records.columns]
    last = _first(records, ["url"], F.col("seq").desc()).drop(*held)
    if not held:
        return last
    older = records.groupBy("url").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in held])
    return last.join(older, "url")


def redirect_hops(records: DataFrame) -> DataFrame:
    """records (seq, url, redirectPaths) as hop, dest: every address of a chain but the last points at the last.

    A chain that returns to its start makes the start point at itself. The latest record of a hop holds.
    """
    chain = F.concat(F.array("url"), F.coalesce("redirectPaths", F.array().cast("array<string>")))
    rows = records.select("seq", chain.alias("chain")).filter(F.size("chain") > 1)
    hops = rows.select("seq", F.element_at("chain", -1).alias("dest"), F.posexplode(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("pos", "hop"))
    return _first(hops, ["hop"], F.col("seq").desc(), F.col("pos").desc()).select("hop", "dest")


def appended_anchors(records: DataFrame) -> DataFrame:
    """Anchors of every record, also of a page that was saved before."""
    return records.select("seq", "url", F.posexplode("anchorList").alias("pos", "a")).select("seq", "url", "pos", "a.*")


def skipped(records: DataFrame) -> DataFrame:
    return records.select("url", F.lit(1).alias("scraped"), F.lit(1).alias("isSkipped"), F.col("reason").alias("skipReason"), "isExternal")


def first_resources(records: DataFrame) -> DataFrame:
    """The first record of each url; compress and cdn default to '0'."""
    first = _first(records, ["url"], "seq")
    return first.withColumns({c: F.coalesce(c, F.lit("0")) for c in ("compress", "cdn") if c in records.columns})


def resource_referrers(links: DataFrame, resources: DataFrame) -> DataFrame:
    """Distinct pairs whose resource is known."""
    return links.join(resources.select(F.col("id").alias("resourceId")), "resourceId", "left_semi").select("resourceId", "pageId").distinct()


def referrers_with_pages(records: DataFrame, resources: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records (src, pageUrl) as pages (id, url), known and new ones, and distinct pairs (resourceId, pageId).

    Records of unknown resources count for nothing; a page that is not known gets a row.
    """
    found = records.join(resources.select(F.col("id").alias("resourceId"), F.col("url").alias("src")), "src").select("resourceId", F.col("pageUrl").alias("url")).distinct()
    pages = ids_for_urls(known, found)
    return pages, found.join(pages, "url").select("resourceId", F.col("id").alias("pageId"))


def url_order(pages: DataFrame, key) -> DataFrame:
    """Internal pages numbered in natural order, others null. key: the sort key column, one range of it at a time.

    Rows are range-partitioned by the key; a partition's offset is the number of rows before it, so no task holds all. The
    ranges are written, so that they are the same where they are counted and where they are numbered.
    """
    inside = pages.filter("isExternal = 0").select("id", "url", key.alias("k"))
    ranged = inside.repartitionByRange("k", "id").sortWithinPartitions("k", "id").withColumn("m", F.monotonically_increasing_id())
    ranged = kept(ranged.select("id", (F.shiftright("m", 33)).alias("part"), (F.col("m").bitwiseAND((1 << 33) - 1)).alias("at")))
    sizes = ranged.groupBy("part").count()
    start = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("start"))
    numbered = ranged.join(start, "part").select("id", (F.col("start") + F.col("at") + 1).alias("order"))
    return pages.drop("order").join(numbered, "id", "left")


def without_snapshot(pages: DataFrame, failed: DataFrame) -> DataFrame:
    """pages whose snapshot could not be written (ids of failed) lose their html."""
    return pages.join(failed.select("id", F.lit(True).alias("__gone")).distinct(), "id", "left").withColumn("html", F.when(F.col("__gone").isNull(), F.col("html"))).drop("__gone")


def errors(records: DataFrame) -> DataFrame:
    """Log lines of error records (pid, isMain, url, stack)."""
    who = F.concat(F.lit("["), F.col("pid").cast("string"), F.when(F.col("isMain"), "(main)").otherwise("(sub)"), F.lit("] "))
    return records.select(F.concat(who, F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("stack", F.lit(""))).alias("line"))
