"""Connected components by repeated joins: least labels of neighbours, then a jump to the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import release, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id in edges (a, b); comp is the smallest id reachable. Rounds grow with the logarithm of a path's length."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "label")
    before = None
    while True:
        total = label.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == before:
            release(both)
            return label
        before = total
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("comp"))
        least = label.union(near.select("a", "comp")).groupBy("id").agg(F.min("comp").alias("comp"))
        up = label.filter("id <> comp").select(F.col("id").alias("comp"), F.col("comp").alias("up"))  # roots stay roots
        label, old = stored(least.join(up, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")), "label"), label
        release(old)


def merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """label (id, comp) after more edges (a, b) between comps; label itself is gone."""
    found = components(edges)
    more = found.filter("id <> comp").select(F.col("id").alias("comp"), F.col("comp").alias("up"))
    new = stored(label.join(more, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")), "label")
    release(label, found)
    return new
