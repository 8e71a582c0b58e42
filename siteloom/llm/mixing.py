"""Mixing sources to target weights: blocks of a fixed number of words, drawn by index.

Every source's documents, in an order given by a hash, are one stream of words cut into blocks. The mix has as many slots
as all targets have blocks, in output shards of SHARD slots. Each slot draws its source by the targets' shares, so the counts
of sources in a shard are a multinomial draw. The draws of all shards are then corrected to the targets: the slots that a
source drew beyond its target, its last ones, go to the sources that drew too few (about the square root of its slots, of
each source). A slot's number within its source runs through the source's blocks in the order of a pseudorandom permutation,
starting again after the last; so no block is taken more than once oftener than another, and with targets of at most three
times a source's size none more than three times. Slots and blocks are joined by (source, index).

Numbers within a source are prefix sums over cells (buckets of about BUCKET documents, or shards), over groups of GROUP cells,
and over a source's groups, so no task sorts a source's documents or slots; sources are numbered by ranges. All of it is
DataFrame expressions.

Nulls and edge cases: a null or wordless text has size 0 and nothing is taken of it; a null source is a source, the last;
a source without words has target 0; a null doc_id is an id like others; repeated rows are separate documents; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import id_or_null, stored, unused

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 128
SHARD = 4096
BUCKET = 256
GROUP = 1024
SEED = 1729
#: Rows that a task makes of spark.range.
MADE = 1 << 18
_WS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    bare = F.trim(text, F.lit(_WS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def running(rows: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name of sums, the sum of its column over all rows before, in a total order.

    Rows are dealt out by ranges; a range's offset is the sum over the ranges before it, one row for each range.
    """
    dealt = stored(rows.withColumns(sums).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select("range", *[F.coalesce(F.sum(c).over(ranges), F.lit(0)).alias(f"from_{c}") for c in sums])
    own = dealt.withColumns({c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})
    return own.join(offsets, "range").withColumns({c: F.col(c) + F.col(f"from_{c}") for c in sums}).drop("range", *[f"from_{c}" for c in sums])


def targets(sizes: DataFrame) -> DataFrame:
    """s (a number), source, source_size, target for every source of (source, size): water-filling in closed form.

    Sources stop at MOST times their size in the order of size over weight; the level is what is left over for the others.
    """
    last = F.col("source").asc_nulls_last()
    by = running(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [last], {"s": F.lit(1).cast("long")})
    weighed = stored(by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("s") % len(WEIGHTS) + 1).cast("int"))), "weighed")
    size, weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    order = [(F.col("source_size") / F.col("weight")).asc(), last]
    filled = running(weighed, order, {"place": F.lit(1).cast("long"), "full": F.col("source_size"), "used": F.col("weight")})
    filled = stored(filled.withColumns({"left": F.lit(size) - MOST * F.col("full"), "weights": F.lit(weights) - F.col("used")}), "filled")
    # the first source that does not stop sets the level for itself and all after it
    # (products as doubles: those of whole numbers overflow, of an int literal already from 2^31 on)
    free = filled.filter(F.col("left").cast("double") * F.col("weight") <= F.col("source_size").cast("double") * MOST * F.col("weights"))
    place, left, over = free.agg(F.min(F.struct("place", "left", "weights"))).first()[0] or (weights + 1, 0, 1)
    level = F.lit(float(left)) * F.col("weight") / F.lit(over)
    return filled.select("s", "source", "source_size", F.when(F.col("place") >= place, level).otherwise(MOST * F.col("source_size")).cast("double").alias("target"))


def _permuted(i: Column, n: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0..n-1: four rounds on the halves of i in a grid of about sqrt(n) by sqrt(n).

    Each round adds a hash of one half to the other, modulo that half's range, so the rounds permute the grid. Places of
    the grid beyond n - 1 (fewer than sqrt(n) + 1) are walked over by going round again; 40 times are enough for any n.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def rounds(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        for k in range(2):
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(SEED + 2 * k), *salt), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(SEED + 2 * k + 1), *salt), b), b)
        return left * b + right

    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), rounds(i), lambda x, _: F.when(x < n, x).otherwise(rounds(x)))


def _before(cells: DataFrame, cell: str, value: str) -> DataFrame:
    """(s, cell, base): the sum of value over the source's cells before."""
    grouped = cells.withColumn("group", F.floor(F.col(cell) / GROUP))
    inside = Window.partitionBy("s", "group").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("s").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("s", "group").agg(F.sum(value).alias("sum"))
    groups = groups.select("s", "group", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("start"))
    own = grouped.withColumn("base", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(groups, ["s", "group"]).select("s", cell, (F.col("base") + F.col("start")).alias("base"))


def streams(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, t, s, size, start) with the place of their first word in their source's stream; and the sources
    with targets."""
    sized = stored(docs.select("doc_id", F.xxhash64("text").alias("t"), "source", n_words(F.col("text")).alias("size")), "sizes")
    sources = stored(targets(sized), "sources")
    buckets = max(1, sized.count() // BUCKET)
    x, y = sized.alias("x"), sources.alias("y")
    keyed = x.join(y, F.expr("x.source <=> y.source")).select("doc_id", "t", "s", "size", F.xxhash64("doc_id", F.lit(SEED)).alias("h"))
    keyed = keyed.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    inside = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    bases = _before(keyed.groupBy("s", "bucket").agg(F.sum("size").alias("words")), "bucket", "words")
    return placed.join(bases, ["s", "bucket"]).select("doc_id", "t", "s", "size", (F.col("before") + F.col("base")).alias("start")), sources


def slots(sources: DataFrame) -> DataFrame:
    """The mix: shard, slot, s and block for every slot."""
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    # as many blocks as come nearest to the target, the last block being shorter; at most MOST times each
    wanted = F.least(F.round(F.col("target") * blocks / F.nullif("source_size", F.lit(0))).cast("long"), MOST * blocks)
    counted = sources.select("s", blocks.alias("blocks"), wanted.alias("wanted")).filter("wanted > 0")
    spans = stored(running(counted, [F.col("s")], {"from": F.col("wanted")}), "spans")
    total, known = spans.agg(F.coalesce(F.sum("wanted"), F.lit(0)), F.count("*")).first()
    # a slot draws a place; a source has a span of places, laid out by cells so that the join is by equal keys
    grid = max(1, total // max(1000, known))
    reach = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / grid), F.floor((F.col("from") + F.col("wanted") - 1) / grid))))
    made = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // MADE))).select(F.col("id").alias("slot"))
    made = made.withColumn("place", F.pmod(F.xxhash64("slot", F.lit(SEED)), F.lit(max(total, 1)))).withColumn("cell", F.floor(F.col("place") / grid))
    drawn = made.join(reach, "cell").filter("place >= from AND place < from + wanted").select("slot", F.floor(F.col("slot") / SHARD).alias("shard"), "s", "wanted")
    counts = drawn.groupBy("s", "shard").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("s", "shard").orderBy("slot")) - 1
    numbered = drawn.withColumn("i", place).join(_before(counts, "shard", "n"), ["s", "shard"]).select("slot", "s", "wanted", (F.col("i") + F.col("base")).alias("j"))
    numbered = stored(numbered, "drawn")
    # what one source drew beyond its target, another lacks: both are laid end to end and met by place
    got = spans.join(numbered.groupBy("s").agg(F.count("*").alias("n")), "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ends = {"spare": F.greatest(F.col("n") - F.col("wanted"), F.lit(0)), "lack": F.greatest(F.col("wanted") - F.col("n"), F.lit(0))}
    even = stored(running(got.select("s", "wanted", "n"), [F.col("s")], ends), "even")
    spare = numbered.filter("j >= wanted").join(even.select("s", "spare"), "s").select("slot", (F.col("spare") + F.col("j") - F.col("wanted")).alias("place"))
    lacking = even.filter("n < wanted").select("s", F.posexplode(F.sequence(F.col("n"), F.col("wanted") - 1)).alias("at", "j"), "lack")
    moved = spare.join(lacking.select("s", "j", (F.col("lack") + F.col("at")).alias("place")), "place").select("slot", "s", "j")
    whole = numbered.filter("j < wanted").select("slot", "s", "j").union(moved).join(spans.select("s", "blocks"), "s")
    block = _permuted(F.pmod("j", F.col("blocks")), F.col("blocks"), F.col("s"))
    return whole.select(F.floor(F.col("slot") / SHARD).alias("shard"), "slot", "s", block.alias("block"))


def pieces(at: DataFrame) -> DataFrame:
    """Documents cut at the blocks' borders: doc_id, t, s, size, start, block, word (its first one's place in the document), words."""
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    cut = at.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest("start", F.col("block") * BLOCK)
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - begin
    return cut.withColumns({"word": begin - F.col("start"), "words": words})


def shards(docs: DataFrame) -> DataFrame:
    """The mix as it would be written: for every slot its pieces (shard, slot, doc_id, word, words)."""
    at, sources = streams(docs)
    return slots(sources).join(pieces(at), ["s", "block"]).select("shard", "slot", "doc_id", "word", "words")


def _taken(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    at, sources = streams(docs)
    draws = slots(sources).groupBy("s", "block").agg(F.count("*").alias("times"))
    taken = (
        pieces(at).join(draws, ["s", "block"], "left").groupBy("doc_id", "t", "s", "size", "start")
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        .select("doc_id", "t", "s", "size", "taken")
    )
    return taken.union(at.filter("size = 0").select("doc_id", "t", "s", "size", F.lit(0).cast("long").alias("taken"))), sources


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document."""
    taken, sources = _taken(docs)
    return taken.join(sources, "s").select("doc_id", "source", "size", "source_size", "target", "taken")


def with_taken(docs: DataFrame) -> DataFrame:
    """docs with all their columns, and size, source_size, target and taken. Columns of docs of these names are replaced.

    Rows that repeat id, source and text share what is taken of them, rounded down.
    """
    taken, sources = _taken(docs)
    d, t = unused(docs, "__d"), unused(docs, "__t")
    some = taken.join(sources, "s").groupBy(id_or_null().alias(d), F.col("t").alias(t), F.col("source").alias("__s"))
    found = some.agg(F.first("size").alias("__size"), F.first("source_size").alias("__of"), F.first("target").alias("__target"), F.expr("sum(taken) div count(*)").alias("__taken"))
    x, y = docs.withColumns({d: id_or_null(), t: F.xxhash64("text")}).alias("x"), found.alias("y")
    joined = x.join(y, F.expr(f"x.{d} = y.{d} AND x.{t} = y.{t} AND x.source <=> y.__s"))
    added = {"size": "__size", "source_size": "__of", "target": "__target", "taken": "__taken"}
    return joined.select(*[F.col(f"x.{c}") for c in docs.columns if c not in added], *[F.col(f"y.{c}").alias(name) for name, c in added.items()])


def mix_digest(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
