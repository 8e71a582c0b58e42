"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound.

Vectors are dealt to shards by space: a tree of cuts learned on a sample of at most SAMPLE vectors (which decides nothing but
where a vector lies) gives each a cell; a cell of more than SHARD vectors, copies of one vector included, is dealt out over
several shards by a hash. Each shard becomes one row with its ball tree and root ball. Queries are packed by cell into blocks
of about BLOCK. A block first searches a shard of its own cell. The k-th scores found there meet the root balls of all shards,
BALLS at a time: a shard goes to a block only if its upper bound reaches the k-th score of one of the block's queries. There a
node's upper bound is <q, centre> + |q| radius, and no more than its parent's; leaves are taken from the highest bound on,
until the bound is below the k-th score, which every leaf visited raises. Bounds are rounded up, equal bounds are visited,
and scores are integers, so results are exact. A row that goes to Python holds one tree and at most SEATS blocks.

Nulls and edge cases: vectors that are null or hold a null or non-finite component take no part; a vector meets only
vectors of its length; a null id takes no part; rows that repeat the query's id count as the query's own, and of those with
different vectors the least vector asks; ties go to the smaller id; with fewer candidates all are returned; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import stored

SHARD, BLOCK, LEAF = 4096, 256, 48
#: Vectors that the cuts are learned on, at most; shards whose root balls a block meets at once; blocks that a shard's tree goes with.
SAMPLE, BALLS, SEATS = 16_384, 1024, 8
SCALE = 256


def integer_vectors(rows: DataFrame, every: int) -> DataFrame:
    """(vec_id, v, query): components floor(256 x); query marks ids that `every` divides."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    return good.select(F.col("vec_id").cast("long"), v.alias("v"), (F.col("vec_id") % every == 0).alias("query"), F.size("embedding").alias("dim"))


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, points = ids[order], vectors[order]
        self.largest = int(np.abs(points).max()) if points.size else 0
        centre, radius, leaf, parent, span = [], [], [], [], []
        at = np.arange(len(points))
        todo = [(0, len(points), -1)]
        while todo:
            a, b, up = todo.pop()
            own = points[at[a:b]].astype(np.float64)
            c = own.mean(0)
            far = ((own - c) ** 2).sum(1)
            node = len(centre)
            centre.append(c)
            radius.append(float(np.sqrt(far.max())))
            parent.append(up)
            span.append((a, b))
            leaf.append(b - a <= LEAF or far.max() == 0)
            if leaf[-1]:
                continue
            # split between two points far apart
            p = own[far.argmax()]
            q = own[((own - p) ** 2).sum(1).argmax()]
            side = np.argsort((own - p) @ (q - p), kind="stable")
            at[a:b] = at[a:b][side]
            mid = (a + b) // 2
            todo += [(a, mid, node), (mid, b, node)]
        self.ids, self.points = self.ids[at], points[at]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.leaf, self.parent, self.span = np.array(leaf), np.array(parent), np.array(span)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of every leaf for every query, rounded up."""
        q = queries.astype(np.float64)
        size = np.sqrt((q**2).sum(1))[:, None]
        reach = np.sqrt((self.centre**2).sum(1)) + self.radius
        upper = q @ self.centre.T + size * self.radius
        upper += 1e-9 * size * reach + 1e-6
        for node in range(1, len(self.parent)):  # parents come before their children
            upper[:, node] = np.minimum(upper[:, node], upper[:, self.parent[node]])
        return upper[:, self.leaf]

    def search(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        """For each query its k best (score, id) here with a score of least[i] or more."""
        upper, spans = self.bounds(queries), self.span[self.leaf]
        exact = queries.shape[1] * max(1, self.largest) * max(1, int(np.abs(queries).max(initial=0))) < 2**53
        kind = np.float64 if exact else np.int64
        points, queries = self.points.astype(kind), queries.astype(kind)
        for i, own in enumerate(ids):
            order = np.argsort(-upper[i], kind="stable")
            best_s, best_id, bar, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), least[i], 0, 1
            while at < len(order) and upper[i, order[at]] >= bar:
                part = [j for j in order[at : at + step] if upper[i, j] >= bar]
                rows = np.concatenate([np.arange(*spans[j]) for j in part])
                s = (points[rows] @ queries[i]).astype(np.int64)
                fit = (s >= bar) & (self.ids[rows] != own)
                best_s, best_id = np.concatenate((best_s, s[fit])), np.concatenate((best_id, self.ids[rows][fit]))
                top = np.lexsort((best_id, -best_s))[:k]
                best_s, best_id = best_s[top], best_id[top]
                if len(best_s) == k:
                    bar = max(bar, int(best_s[-1]))
                at, step = at + step, step * 3
            yield best_s, best_id


def cuts(points: np.ndarray, least: int) -> list[tuple[np.ndarray, float]]:
    """A tree of cuts as a heap (direction, limit): node n has 2n+1 below and 2n+2 above its limit; fewer than 2 * least points
    end it (a direction of zeros, so that all go below)."""
    out: list = []
    todo = {0: points}
    at = 0
    while todo and at < 2 * max(1, len(points) // least):
        own = todo.pop(at, None)
        if own is not None and len(own) >= 2 * least:
            p = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
            q = own[((own - p) ** 2).sum(1).argmax()]
            side = own @ (q - p)
            limit = float(np.median(side))
            if (side > limit).any():
                out.append((q - p, limit))
                todo[2 * at + 1], todo[2 * at + 2] = own[side <= limit], own[side > limit]
                at += 1
                continue
        out.append((np.zeros(points.shape[1]), 0.0))
        at += 1
    return out


def _cells(trees: dict[int, tuple[np.ndarray, np.ndarray]]):
    """The cell of every vector: the node where its way down the cuts of its length ends."""

    def cell(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int64)
        sizes = vectors.map(len).to_numpy()
        for dim in np.unique(sizes):
            way, limit = trees.get(int(dim), (np.zeros((0, dim)), np.zeros(0)))
            own = np.flatnonzero(sizes == dim)
            v = np.stack(vectors.iloc[own].to_numpy()).astype(float) if dim else np.zeros((len(own), 0))
            node = np.zeros(len(own), np.int64)
            live = np.arange(len(own)) if len(limit) else np.zeros(0, int)
            while len(live):
                side = (v[live] * way[node[live]]).sum(1) > limit[node[live]]
                node[live] = 2 * node[live] + 1 + side
                live = live[node[live] < len(limit)]
            out[own] = node
        return pd.Series(out)

    return F.pandas_udf(cell, "long")


def _trees(batch: pd.DataFrame) -> pd.DataFrame:
    tree = BallTree(batch["vec_id"].to_numpy(np.int64), np.stack(batch["v"].to_numpy()).astype(np.int64))
    root = {"centre": [tree.centre[0]], "radius": [float(tree.radius[0])], "tree": [pickle.dumps(tree, 5)]}
    return pd.DataFrame({"dim": batch["dim"].iloc[:1], "cell": batch["cell"].iloc[:1], "part": batch["part"].iloc[:1], **root})


def _blocks(batch: pd.DataFrame) -> pd.DataFrame:
    ids, v = batch["vec_id"].to_numpy(np.int64), np.stack(batch["v"].to_numpy()).astype(np.int64)
    return pd.DataFrame({"dim": batch["dim"].iloc[:1], "cell": batch["cell"].iloc[:1], "block": batch["block"].iloc[:1], "queries": [pickle.dumps((ids, v), 5)]})


def _least(ids: np.ndarray, bars) -> np.ndarray:
    known = dict(bars) if bars is not None else {}
    return np.array([known.get(int(i), -(2**63)) for i in ids], np.int64)


def _search(k: int):
    def run(batches):
        for batch in batches:
            for packed, seats in zip(batch["tree"], batch["seats"], strict=True):
                tree, out = pickle.loads(packed), []
                for seat in seats:
                    ids, v = pickle.loads(seat["queries"])
                    for i, (s, found) in zip(ids, tree.search(ids, v, _least(ids, seat["bars"]), k), strict=True):
                        out += [(int(i), int(x), int(y)) for x, y in zip(found, s, strict=True)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def _reached(batches):
    """(dim, cell, part, block_cell, block) of the shards whose root ball reaches a k-th score of the block."""
    names = ["dim", "cell", "part", "block_cell", "block"]
    for batch in batches:
        out = []
        for dim, at, block, packed, bars, balls in zip(*(batch[c] for c in ("dim", "block_cell", "block", "queries", "bars", "balls")), strict=True):
            ids, v = pickle.loads(packed)
            q, centre, radius = v.astype(float), np.stack([b["centre"] for b in balls]), np.array([b["radius"] for b in balls])
            size = np.sqrt((q**2).sum(1))[:, None]
            upper = q @ centre.T + size * radius + 1e-9 * size * (np.sqrt((centre**2).sum(1)) + radius) + 1e-6
            for n in np.flatnonzero((upper >= _least(ids, bars)[:, None].astype(float)).any(axis=0)):
                out.append((dim, balls[n]["cell"], balls[n]["part"], at, block))
        yield pd.DataFrame(out, columns=names).astype({"dim": "int32", "cell": "int64", "part": "int32", "block_cell": "int64", "block": "int32"})


def _learned(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Cuts into cells of about SHARD vectors for every length of vector, from SAMPLE vectors at most, chosen by a hash."""
    total = max(1, vectors.count())
    picked: dict[int, list] = {}
    for r in vectors.select("dim", "v").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).collect():
        picked.setdefault(r["dim"], []).append(r["v"])
    least = max(16, SHARD * sum(map(len, picked.values())) // (2 * total))
    found = {dim: cuts(np.array(v, float), least) for dim, v in picked.items() if dim}
    return {dim: (np.stack([w for w, _ in c]), np.array([x for _, x in c])) for dim, c in found.items() if c}


def top_k(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    vectors = stored(integer_vectors(rows, every), "vectors")
    vectors = stored(vectors.withColumn("cell", _cells(_learned(vectors))("v")), "cells")
    parts = vectors.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    shard = ["dim", "cell", "part"]
    made = vectors.join(parts, ["dim", "cell"]).select("vec_id", "v", "dim", "cell", part).groupBy(shard)
    trees = stored(made.applyInPandas(_trees, "dim int, cell long, part int, centre array<double>, radius double, tree binary"), "trees")

    asked = vectors.filter("query").groupBy("vec_id", "dim").agg(F.min(F.struct("v", "cell")).alias("x")).select("vec_id", "dim", "x.*")
    one = Window.partitionBy("vec_id").orderBy("dim")
    asked = stored(asked.withColumn("n", F.row_number().over(one)).filter("n = 1").drop("n"), "asked")
    blocks = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    placed = stored(asked.join(blocks, ["dim", "cell"]).select("vec_id", "v", "dim", "cell", block), "placed")
    packed = stored(placed.groupBy("dim", "cell", "block").applyInPandas(_blocks, "dim int, cell long, block int, queries binary"), "blocks")

    schema, kind = "query_id long, vec_id long, score long", "array<struct<query_id:bigint,bar:bigint>>"
    seat = F.struct("queries", "bars")

    def searched(seats: DataFrame, tag: str) -> DataFrame:
        """seats (dim, cell, part, queries, bars), dealt to copies of the shard's tree."""
        count = seats.groupBy(shard).agg(F.ceil(F.count("*") / SEATS).cast("int").alias("copies"))
        copies = trees.select(*shard, "tree").join(count, shard).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        copy = F.pmod(F.xxhash64("queries"), F.col("copies")).cast("int").alias("copy")
        dealt = seats.join(count, shard).select(*shard, copy, seat.alias("seat")).groupBy(*shard, "copy").agg(F.collect_list("seat").alias("seats"))
        return stored(dealt.join(copies, [*shard, "copy"]).select("tree", "seats").mapInPandas(_search(k), schema), tag)

    home = packed.withColumn("part", F.lit(0)).withColumn("bars", F.lit(None).cast(kind))
    first = searched(home, "home")
    bars = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bar")).filter(F.col("n") >= k)
    of_block = placed.select("dim", "cell", F.col("vec_id").alias("query_id"), "block").join(bars, "query_id")
    of_block = of_block.groupBy("dim", "cell", "block").agg(F.collect_list(F.struct("query_id", "bar")).alias("bars"))
    packed = packed.join(of_block, ["dim", "cell", "block"], "left").select("dim", F.col("cell").alias("block_cell"), "block", "queries", "bars")
    packed = stored(packed, "barred")
    groups = trees.groupBy("dim").agg(F.ceil(F.count("*") / BALLS).cast("int").alias("groups"))
    group = F.pmod(F.xxhash64("cell", "part"), F.col("groups")).cast("int").alias("group")
    balls = trees.join(groups, "dim").select("dim", group, F.struct("cell", "part", "centre", "radius").alias("ball")).groupBy("dim", "group").agg(F.collect_list("ball").alias("balls"))
    offered = packed.join(groups, "dim").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).join(balls, ["dim", "group"])
    pairs = offered.mapInPandas(_reached, "dim int, cell long, part int, block_cell long, block int").filter("cell <> block_cell OR part <> 0")
    rest = searched(stored(pairs, "pairs").join(packed, ["dim", "block_cell", "block"]).select(*shard, "queries", "bars"), "rest")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
