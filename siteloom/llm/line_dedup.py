"""Removal of lines that many documents share.

Hashes of line keys are range-partitioned by (hash, document) and sorted by document, largest first, so a line's first
occurrence in the stream is the one that stays. A task decides every line whose run begins and ends within a batch. A run
that crosses a batch or partition border goes on as undecided rows plus one count for each piece; those counts (a few for
each batch) are added up and joined back to the rows by hash and piece. A piece lies within one partition, so a line that
a third of all documents hold is spread over as many tasks as it has pieces, and no task holds a run. Results are compressed bitmaps of dropped lines, one for each document that loses any.

Nulls and edge cases: a null or empty text is one empty line; a null doc_id counts as one id below all others; rows that
repeat a doc_id count as one document and lose or keep the same lines; extra columns pass through; the order of lines and
all other lines stay as they are.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siteloom.llm.common import id_or_null, runs, stored

STRIPPED = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5

#: kind 0: a drop that is settled; 1: a row of a run that crosses a border; 2: the count of a piece of such a run.
#: piece: the partition that a piece lies in, which tells the pieces of a run apart.
_STREAM = "kind int, h1 long, h2 long, piece int, d long, t long, n_lines int, at array<int>, n long"


def _line_keys(batches):
    for batch in batches:
        out = []
        for d, t, text in zip(batch["d"], batch["t"], batch["text"], strict=True):
            lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
            places: dict[bytes, list[int]] = {}
            for at, line in enumerate(lines):
                key = line.strip(STRIPPED)
                if len(key) >= MIN_CHARS and len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS:
                    places.setdefault(key.lower(), []).append(at)
            for key, at in places.items():
                h = xxhash.xxh3_128_intdigest(key)
                out.append(((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, d, t, len(lines), at))
        yield pd.DataFrame(out, columns=["h1", "h2", "d", "t", "n_lines", "at"])


def _stream(batches):
    """Runs of one hash, from rows sorted by (h1, h2, d descending)."""
    columns = ["kind", "h1", "h2", "piece", "d", "t", "n_lines", "at", "n"]
    task = TaskContext.get()
    here = task.partitionId() if task else 0
    open_ = None  # [h1, h2, documents so far, largest doc, last doc] of the run that crosses the border

    def piece(state):
        return pd.DataFrame([(2, state[0], state[1], here, state[3], 0, 0, [], state[2])], columns=columns)

    for batch in batches:
        if batch.empty:
            continue
        cut = runs(batch, ["h1", "h2"])
        d, head = batch["d"].to_numpy(), batch[["h1", "h2"]].to_numpy()
        sure = []
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            same = open_ is not None and head[a, 0] == open_[0] and head[a, 1] == open_[1]
            if k == 0 and open_ is not None and not same:
                yield piece(open_)
                open_ = None
            if same or (k == 0 and open_ is None) or b == len(batch):
                if not same:
                    if open_ is not None:
                        yield piece(open_)
                    open_ = [head[a, 0], head[a, 1], 0, d[a], None]
                open_[2] += int(np.count_nonzero(np.diff(d[a:b]))) + (open_[4] is None or open_[4] != d[a])
                open_[4] = d[b - 1]
                part = batch.iloc[a:b].assign(kind=1, piece=here, n=0)
                yield part[columns]
            elif b - a >= MIN_DOCS and np.count_nonzero(np.diff(d[a:b])) + 1 >= MIN_DOCS:
                sure.append(np.arange(a, b)[d[a:b] != d[a]])
        if sure:
            yield batch.iloc[np.concatenate(sure)].assign(kind=0, piece=here, n=0)[columns]
    if open_ is not None:
        yield piece(open_)


def _pack(at: pd.Series, n_lines: pd.Series) -> pd.Series:
    def one(places, n):
        keep = np.ones(int(n), bool)
        keep[np.asarray(places, int)] = False
        return zlib.compress(np.packbits(keep).tobytes(), 1)

    return pd.Series([one(*x) for x in zip(at, n_lines, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(d, t, keep): for each document that loses a line, its id and text hash and a compressed bitmap of kept lines."""
    lines = stored(
        docs.select(id_or_null().alias("d"), F.xxhash64("text").alias("t"), "text")
        .mapInPandas(_line_keys, "h1 long, h2 long, d long, t long, n_lines int, at array<int>"),
        "lines",
    )
    seen = stored(
        lines.repartitionByRange("h1", "h2", F.col("d").desc())
        .sortWithinPartitions("h1", "h2", F.col("d").desc(), "t")
        .mapInPandas(_stream, _STREAM),
        "runs",
    )
    pieces = seen.filter("kind = 2")
    totals = pieces.groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("d").alias("stays")).filter(F.col("docs") >= MIN_DOCS)
    decided = pieces.select("h1", "h2", "piece").join(totals.select("h1", "h2", "stays"), ["h1", "h2"])
    late = seen.filter("kind = 1").drop("n").join(decided, ["h1", "h2", "piece"]).filter("d <> stays")
    drops = seen.filter("kind = 0").select("d", "t", "n_lines", "at").unionByName(late.select("d", "t", "n_lines", "at"))
    by_doc = drops.groupBy("d", "t").agg(F.max("n_lines").alias("n"), F.flatten(F.collect_list("at")).alias("at"))
    return by_doc.select("d", "t", pandas_udf(_pack, "binary")("at", "n").alias("keep"))


def _apply(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    out = []
    for t, k in zip(text, keep, strict=True):
        t = t or ""
        if k is None:
            out.append((t.count("\n") + 1, 0, t))
            continue
        lines = t.split("\n")
        flags = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=len(lines))
        kept = [x for x, f in zip(lines, flags, strict=True) if f]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])


def without_shared_lines(docs: DataFrame, out: str = "lines") -> DataFrame:
    """docs with a column `out`: struct of n_lines, n_dropped and kept (the text that is left)."""
    keyed = docs.withColumns({"__d": id_or_null(), "__t": F.xxhash64("text")})
    maps = keep_bitmaps(docs).select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("keep").alias("__keep"))
    joined = keyed.join(maps, ["__d", "__t"], "left")
    return joined.withColumn(out, pandas_udf(_apply, "n_lines long, n_dropped long, kept string")("text", "__keep")).drop("__d", "__t", "__keep")


def _digest(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    made = _apply(text, keep)
    made["kept_sha256"] = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in made.pop("kept")]
    return made


def line_digests(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumns({"d": id_or_null(), "t": F.xxhash64("text")})
    joined = keyed.join(keep_bitmaps(docs), ["d", "t"], "left").withColumn("x", pandas_udf(_digest, "n_lines long, n_dropped long, kept_sha256 string")("text", "keep"))
    return joined.select("doc_id", "x.n_lines", "x.n_dropped", "x.kept_sha256")
