"""Benchmark passages in documents, by spaced seeds.

Words are compared in lower case and without ASCII punctuation; a character of a script written without spaces is a word.
Five fixed masks of weight five are laid at every word; a 0 in a mask is a place that may differ, so a passage with up to
every fifth word replaced still shares a seed. Seed hashes of the documents are joined with those of the benchmark. Each
shared seed names a document, an item and an alignment; there the words are compared one by one. A passage counts as copied
where a window of 13 aligned words (the whole item, if it is shorter) has at least 80 % equal words. Where a benchmark has
items that the five masks do not cover (of 3, 4, 5 or 10 words), masks for these are laid as well.

The benchmark's seeds go to the executors in slices of at most SLICE words (or one item, if that is longer), one pass over
the documents for each slice. A pass is run and written before the next slice is read, so the driver and every worker hold
one slice whatever the benchmark's size. Items that repeat go once, with their count.

Nulls and edge cases: null and empty texts match nothing; items of one or two words are left out, as they are ordinary prose
and no passage; rows with a null doc_id are reported with it; repeated items and documents are reported each; extra columns
are not read or pass through.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import NULL_ID, hash_words, id_or_null, mix, small_batches, stored, unused

MASKS = ("11111", "111101", "111011", "110111", "101111")
#: Masks for items of so many words, which 80 % of equal words can leave without a seed of the five.
MORE = {3: ("111",), 4: ("1111",), 5: ("01111", "10111", "11011", "11101", "11110"), 10: ("1111001",)}
WINDOW = 13
LEAST_WORDS = 3
PERCENT = 80
#: Benchmark words of a slice: a million seeds of 16 bytes and a table of 32 to 64 bytes for each, 80 MB at most.
SLICE = 200_000
#: Pairs of a place and a posting that are made at once.
PAIRS = 1 << 20
_FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
#: Thai to Myanmar, Khmer, kana, and Han characters.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_SHIFT = 1 << 31  # an alignment is item << 32 | shift + _SHIFT, as one number


def words(text: str | None) -> np.ndarray:
    text = (text or "").lower()
    try:
        text.encode("latin-1")  # the quickest test that rules such scripts out
    except UnicodeEncodeError:
        text = _UNSPACED.sub(r" \1 ", text)
    return hash_words(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())


def seeds(w: np.ndarray, masks=MASKS):
    """For each mask that fits, the hashes at every place."""
    for mask in masks:
        n = len(w) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, int(mask, 2) << 4 | len(mask), np.uint64)
        for at, bit in enumerate(mask):
            if bit == "1":
                h = h * np.uint64(0x9E3779B97F4A7C15) + w[at : at + n]
        yield mix(h)


class Index:
    """Seeds of one slice of the benchmark, and a table that rules most places out. items: (item_id, text) and how many
    rows are so, if more than one."""

    def __init__(self, items: list[tuple]):
        self.ids, self.items, self.times = [], [], []
        hashes, item, place = [], [], []
        more: set[int] = set()
        for key, text, *times in items:
            w = words(text)
            if len(w) < LEAST_WORDS:
                continue
            more |= {len(w)} & set(MORE)
            for h in seeds(w, MASKS + MORE.get(len(w), ())):
                hashes.append(h)
                item.append(np.full(len(h), len(self.items), np.int32))
                place.append(np.arange(len(h), dtype=np.int32))
            self.ids.append(key)
            self.times.append(times[0] if times else 1)
            self.items.append(w)
        self.masks = MASKS + tuple(m for n in sorted(more) for m in MORE[n])
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int32))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int32))[order]
        self.bits = np.uint64(max(16, int(np.ceil(np.log2(max(1, len(h)) * 32)))))
        self.table = np.zeros(1 << int(self.bits), bool)
        self.table[self.hashes >> (np.uint64(64) - self.bits)] = True

    def alignments(self, w: np.ndarray) -> list[tuple[int, int]]:
        """The different (item, shift) that share a seed with the document."""
        found = np.zeros(0, np.int64)
        for h in seeds(w, self.masks):
            at = np.flatnonzero(self.table[h >> (np.uint64(64) - self.bits)])
            if not len(at):
                continue
            low = np.searchsorted(self.hashes, h[at])
            real = self.hashes[np.minimum(low, len(self.hashes) - 1)] == h[at]
            if not real.any():
                continue
            at, low = at[real], low[real]
            high = np.searchsorted(self.hashes, h[at], "right")
            ends = np.cumsum(high - low)
            first = 0
            while first < len(at):  # postings of so many places that PAIRS are not much exceeded
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
                n = (high - low)[first:last]
                e = np.repeat(low[first:last] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                codes = (self.item[e].astype(np.int64) << 32) | (np.repeat(at[first:last], n) - self.place[e] + _SHIFT)
                found = np.union1d(found, codes)
                first = last
        return [(int(c) >> 32, (int(c) & 0xFFFFFFFF) - _SHIFT) for c in found]

    def matches(self, text: str | None):
        """(item_id, equal words, first and last+1 word of the document, the item's words) for each copied item, at its best alignment."""
        w = words(text)
        best: dict[int, tuple] = {}
        for item, shift in self.alignments(w) if len(w) >= LEAST_WORDS else ():
            own = self.items[item]
            a, b = max(0, -shift), min(len(own), len(w) - shift)
            need = min(WINDOW, len(own))
            if b - a < need:
                continue
            same = np.concatenate(([0], np.cumsum(own[a:b] == w[a + shift : b + shift])))
            good = np.flatnonzero(100 * (same[need:] - same[:-need]) >= PERCENT * need)
            if not len(good):
                continue
            lo, hi = int(good[0]), int(good[-1]) + need
            row = (int(same[hi] - same[lo]), -(a + shift + lo), a + shift + hi, len(own))
            best[item] = max(best.get(item, row), row)
        for item, (n, start, end, size) in best.items():
            yield from [(self.ids[item], n, -start, end, size)] * self.times[item]


def _benchmark(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, times) of the different items, and the number of slices."""
    rows = stored(benchmark.filter("text IS NOT NULL").groupBy("item_id", "text").agg(F.count("*").alias("times")), "benchmark")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows, max(1, -(-total // (2 * SLICE)))  # a word and its gap have two characters at least


def _index(docs: DataFrame, rows: DataFrame, slices: int, i: int):
    """The index of slice i, broadcast."""
    own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i)
    return docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in own.collect()]))


def _passes(docs: DataFrame, benchmark: tuple[DataFrame, int], scan):
    """scan(docs, index) for every slice, one after the other; each but an only one is written before the next is read."""
    for i in range(benchmark[1]):
        index = _index(docs, *benchmark, i)
        found = scan(docs, index)
        if benchmark[1] == 1:
            yield found
        else:
            yield stored(found, "slice")
            index.unpersist()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it copies from: doc_id, item_id, n_match, doc_start, doc_end, item_words, similarity."""
    small_batches(docs.sparkSession)
    names = ["doc", "item_id", "n_match", "doc_start", "doc_end", "item_words", "similarity"]
    schema = "doc long, item_id long, n_match long, doc_start long, doc_end long, item_words long, similarity double"

    def scanned(docs: DataFrame, index) -> DataFrame:
        def scan(batches):
            for batch in batches:
                out = [(d, *m, m[1] / (m[3] - m[2])) for d, t in zip(batch["doc"], batch["text"], strict=True) for m in index.value.matches(t)]
                yield pd.DataFrame(out, columns=names).astype({"doc": "int64", "item_id": "Int64"})

        return docs.mapInPandas(scan, schema)

    found = reduce(DataFrame.union, _passes(docs.select(id_or_null().alias("doc"), "text"), _benchmark(benchmark), scanned))
    return found.select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), *names[1:])


def _copies(index):
    def copies(texts: pd.Series) -> pd.Series:
        return pd.Series([next(iter(index.value.matches(t)), None) is not None for t in texts], dtype=bool)

    return F.pandas_udf(copies, "boolean")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark; all their columns.

    One slice is one filter; of several, each writes the ids and text hashes it finds, and those rows go in one join.
    """
    small_batches(docs.sparkSession)
    d, t = unused(docs, "__d"), unused(docs, "__t")
    keyed = docs.withColumns({d: id_or_null(), t: F.xxhash64("text")})
    rows = _benchmark(benchmark)
    if rows[1] == 1:
        return docs.filter(~_copies(_index(docs, *rows, 0))("text"))
    found = _passes(keyed, rows, lambda some, index: some.filter(_copies(index)("text")).select(d, t))
    return keyed.join(reduce(DataFrame.union, found).distinct(), [d, t], "left_anti").select(docs.columns)
