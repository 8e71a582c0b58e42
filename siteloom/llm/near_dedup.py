"""Near-duplicate groups by HyperMinHash sketches, confirmed on whole shingle sets.

1. A document's sketch has 128 registers. A shingle's hash picks a register; the register keeps the least hash seen, as a
   leading-zero count (6 bits) and the 10 bits after the leading one. Documents with equal shingle sets are one class.
2. Four registers make a band: 32 bands. At a similarity of 0.8 two classes share no band with probability 5e-8.
3. Classes that share a band are candidates. An estimate from the registers, corrected for chance collisions and with four
   standard errors of slack, leaves out hopeless pairs; the others are confirmed on their full sets. Registers sample the
   union without replacement, so the error shrinks with the share of the union they hold.
4. Only components matter, so not every pair is tested. Round 1 pairs each class with the most central class of its
   bands. A screening then finds the classes that may still have a link to another component, and these get sketches
   of 512 registers. Round 2 pairs them with their best partner in another component, round 3 with every remaining
   candidate of another component. Pairs inside a component are never made, and a pair is made in the first bucket it
   shares only. Buckets of the same members are read once. Large buckets are split into blocks; members outside the
   bucket's main component meet every block, in bounded memory.

Nulls and edge cases: a null text or one without words has an empty set, links with nothing and stays; with fewer words
than a shingle the whole sequence is the one shingle; a null doc_id takes part but is never a component's id unless the
component has no other; repeated rows are one class, and so are rows of different ids or none with equal sets; one id may
stand for several texts, each of which is in its own group; extra columns are not read, and pass through one_of_each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siteloom.llm.common import NULL_ID, hash_words, id_or_null, mix, release, runs, stored, unused, whole_groups
from siteloom.llm.components import components, merged

BANDS, PER_BAND = 32, 4
REGISTERS = BANDS * PER_BAND
#: The logarithm of the number of registers: of the sketch that is banded, and of the one that rounds 2 and 3 estimate with.
COARSE, FINE = 7, 9
MANTISSA = 10
#: Chance that registers of two different minima agree: a third of 2^-MANTISSA.
COLLISION = 2.0**-MANTISSA / 3
WIDTH = 5
PERCENT = 80
#: Members of a bucket that one block holds, and spokes that are confirmed against a hub in one run of rows.
BLOCK, SPOKES = 512, 256


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = hash_words(words)
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    return np.unique(mix(h))


def sketch(hashes: np.ndarray, bits: int = COARSE) -> np.ndarray:
    """2^bits registers of 16 bits from sorted hashes; 0 is an empty register."""
    registers = np.zeros(1 << bits, np.uint16)
    slot, first = np.unique(hashes >> np.uint64(64 - bits), return_index=True)
    value = (hashes[first] << np.uint64(bits) >> np.uint64(12)).astype(np.float64)
    part, exponent = np.frexp(value)
    zeros = np.where(value > 0, 52 - exponent, 52)
    leading = np.where(value > 0, (2 * part - 1) * 2**MANTISSA, 0)
    registers[slot.astype(int)] = (zeros + 1).astype(np.uint16) << MANTISSA | leading.astype(np.uint16)
    return registers


def _signatures(width):
    def run(batches):
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingles(text, width)
                k = xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None
                out.append((len(s), k, sketch(s).view(np.int64) if len(s) else None))
            yield pd.DataFrame({"doc": batch["doc"], "t": batch["t"], "n": [x[0] for x in out], "k": pd.array([x[1] for x in out], "Int64"), "bands": [x[2] for x in out]})

    return run


def agreement(a: np.ndarray, b: np.ndarray, both: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """True where registers leave a similarity of PERCENT possible, and the estimate.

    a and b: registers, the last axis being theirs; both: the sum of the sets' sizes, if known. At the threshold t the union has
    both / (1 + t) members; the m full registers hold m of them drawn without replacement, so the variance is
    t (1 - t) / m times the share not drawn. One register of slack is for the rounding of the collisions' correction.
    """
    full = np.maximum(np.count_nonzero((a != 0) | (b != 0), axis=-1), 1)
    same = np.count_nonzero((a == b) & (a != 0), axis=-1)
    estimate = (same / full - COLLISION) / (1 - COLLISION)
    t = PERCENT / 100
    left = 1.0
    if both is not None:
        union = np.maximum(both / (1 + t), 2)
        left = np.clip((union - full) / (union - 1), 0, 1)
    return estimate >= t - 4 * np.sqrt(t * (1 - t) / full * left) - 1 / full, estimate


def sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _registers(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64).view(np.uint16)


def _estimate(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    """The estimated similarity; null if a link is out of the question."""
    if not len(a):
        return pd.Series([], dtype="Float64")
    na, nb = na.to_numpy(), nb.to_numpy()
    can, estimate = agreement(_registers(a), _registers(b), na + nb)
    can &= sizes_allow(na, nb)
    return pd.Series(np.where(can, estimate, np.nan)).astype("Float64").where(can)


def _met(batches, fine: bool):
    """Per group of rows sorted by bucket, block and visit: (k, guest rows' index, partners' indices, their estimates).

    side 0: the block's members; side 1: guests, members outside the bucket's main component that visit the block. A pair
    of classes meets in the first of the buckets that both are in, and two guests of a bucket meet once.
    """
    bit = np.int64(1) << np.arange(BANDS, dtype=np.int64)
    for frame in whole_groups(batches, ["bucket", "block", "visit"]):
        cut = runs(frame, ["bucket", "block", "visit"])
        k, comp, n, side, guest, band, mask = (frame[c].to_numpy() for c in ("k", "comp", "n", "side", "guest", "band", "mask"))
        bands = np.stack(frame["bands"].to_numpy()).astype(np.int64)
        regs = _registers(frame["fine"]) if fine else bands.view(np.uint16)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = np.arange(a, b)[side[a:b] == 0]
            for i in np.arange(a, b)[side[a:b] == 1]:
                j = own[(comp[own] != comp[i]) & sizes_allow(n[own], n[i]) & ((k[own] > k[i]) | ~guest[own])]
                j = j[((bands[j] == bands[i]) & (mask[i] & bit != 0)).argmax(axis=1) == band[i]]
                if len(j):
                    can, near = agreement(regs[j], regs[i], n[j] + n[i])
                    if can.any():
                        yield k, i, j[can], near[can]


def _screened(batches):
    """The classes that have a candidate in another component, each once in a batch of rows."""
    found: set[int] = set()
    for k, i, j, _ in _met(batches, fine=False):
        found.add(int(k[i]))
        found.update(k[j].tolist())
        if len(found) >= 10_000:
            yield pd.DataFrame({"k": list(found)}, dtype="int64")
            found = set()
    yield pd.DataFrame({"k": list(found)}, dtype="int64")


def _candidates(best_only: bool):
    """Candidate pairs of different components, of each guest and block the best or all."""

    def run(batches):
        out: list[tuple[int, int]] = []
        for k, i, j, near in _met(batches, fine=True):
            if best_only:
                j = j[near.argmax()][None]
            out += [(min(k[i], x), max(k[i], x)) for x in k[j]]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
                out = []
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _fine(batches):
    """(k, 512 registers) of (k, hashes)."""
    for batch in batches:
        regs = [sketch(np.frombuffer(raw, np.uint64), FINE).view(np.int64) for raw in batch["hashes"]]
        yield pd.DataFrame({"k": batch["k"], "fine": pd.Series(regs, dtype=object)})


def _confirm(batches):
    """Links from rows (hub, chunk, spoke, hashes) sorted so that the hub's own row (no spoke) comes first."""
    at, hub = None, None
    for batch in batches:
        out = []
        for h, c, s, raw in zip(batch["hub"], batch["chunk"], batch["spoke"], batch["hashes"], strict=True):
            own = np.frombuffer(raw, np.uint64)
            if s == h:
                at, hub = (h, c), own
                continue
            if at != (h, c):
                continue
            common = len(np.intersect1d(hub, own, assume_unique=True))
            if 100 * common >= PERCENT * (len(hub) + len(own) - common):
                out.append((h, s))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (hub, spoke) that the full sets confirm. A hub's spokes are dealt out in chunks."""
    chunks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPOKES).alias("chunks"))
    dealt = stored(
        pairs.join(chunks, "hub").select("hub", "spoke", F.pmod(F.xxhash64("spoke"), F.col("chunks")).alias("chunk")), "pairs"
    )
    spokes = dealt.join(sets, F.col("spoke") == F.col("k")).select("hub", "chunk", "spoke", "hashes")
    hubs = dealt.select("hub", "chunk").distinct().join(sets, F.col("hub") == F.col("k")).select("hub", "chunk", F.col("hub").alias("spoke"), "hashes")
    links = stored(
        spokes.union(hubs).withColumn("later", F.col("hub") != F.col("spoke"))
        .repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "later").drop("later")
        .mapInPandas(_confirm, "a long, b long"),
        "links",
    )
    release(dealt)
    return links


def _part() -> Column:
    """The part of its bucket that a member is dealt to; a part has about BLOCK members."""
    return F.pmod(F.xxhash64("k", F.lit(2)), F.ceil(F.col("size") / BLOCK))


def _in_parts(buckets: DataFrame) -> DataFrame:
    """Rows of buckets, once for each part, so that members join them without all of a large bucket in one task."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK) - 1))).drop("size")


def _meetings(member: DataFrame, label: DataFrame, about: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, block, visit, side, k, comp, guest, band, mask, ...about) of the buckets with several components, sorted for _met.

    A bucket's members are dealt out in blocks. Those outside its main component are guests; they are dealt out as well, in
    visits of about BLOCK, and go to every block, which appears once for each visit. Members with their bucket's main component
    are written once, as three parts of the plan read them, and returned second, to be released.
    """
    inside = stored(member.join(label, F.col("k") == F.col("id")).join(about.select("k"), "k").select("bucket", "size", "band", "mask", "k", "comp"), "inside")
    by_comp = inside.groupBy("bucket", "size", "comp").agg(F.count("*").alias("c"))
    main = (
        by_comp.groupBy("bucket", "size").agg(F.count("*").alias("comps"), F.sum("c").alias("members"), F.max("c").alias("own"), F.max_by("comp", F.struct("c", "comp")).alias("main"))
        .filter("comps > 1").select("bucket", "size", "main", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("members") - F.col("own")) / BLOCK).cast("int").alias("visits"))
    )
    mixed = stored(inside.withColumn("part", _part()).join(_in_parts(main), ["bucket", "part"]).withColumn("guest", F.col("comp") != F.col("main")), "mixed")
    release(inside)
    keep = ["bucket", "block", "visit", "side", "band", "mask", "k", "comp", "guest"]
    guests = mixed.filter("guest").withColumn("visit", F.pmod(F.xxhash64("k", F.lit(1)), F.col("visits")).cast("int"))
    seats = guests.select("bucket", "visit", "blocks").distinct().select("bucket", "visit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    home = mixed.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("side", F.lit(0))
    rows = home.join(seats, ["bucket", "block"]).select(keep).union(
        guests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1)).select(keep)
    )
    return rows.join(about, "k").repartition("bucket", "block", "visit").sortWithinPartitions("bucket", "block", "visit", "side"), mixed


def _sets(width):
    def run(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch["k"], batch["text"], strict=True):
                out.append((k, shingles(text, width).tobytes()))
            yield pd.DataFrame(out, columns=["k", "hashes"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, t, text): id and text hash, which tell texts apart whatever ids are null or repeated."""
    return docs.select(id_or_null().alias("doc"), F.xxhash64("text").alias("t"), "text")


def _grouped(docs: DataFrame, width: int) -> DataFrame:
    """One row for each row of docs: doc, t, n, and class_id and comp_id, which are null for an empty set; k, the class."""
    signed = stored(_texts(docs).mapInPandas(_signatures(width), "doc long, t long, n long, k long, bands array<bigint>"), "signatures")
    classes = stored(
        signed.filter("k IS NOT NULL").groupBy("k")
        .agg(F.min(F.struct("doc", "t")).alias("rep"), F.min(F.when(F.col("doc") != NULL_ID, F.col("doc"))).alias("least"), F.min("n").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    banded = classes.select("k", F.posexplode("bands").alias("band", "value")).filter("value <> 0")
    banded = banded.select(F.xxhash64("band", "value").alias("bucket"), "band", "k")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("who")).filter("size > 1")
    # of buckets with the same members, one is enough; the others only add to a member's weight
    shared = stored(shared, "buckets")
    once = shared.groupBy("size", "who").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times")).select("bucket", "size", "times")
    member = stored(banded.join(once, "bucket"), "members")
    release(shared)

    weight = member.groupBy("k").agg(F.sum(F.col("size") * F.col("times")).alias("weight"), F.sum(F.expr("shiftleft(1L, band)")).alias("mask"))
    weighed = stored(member.join(weight, "k").select("bucket", "size", "band", "k", "mask", "weight"), "weighed")
    release(member)
    hub = weighed.groupBy("bucket", "size").agg(F.max_by("k", F.struct("weight", "k")).alias("hub"))
    star = weighed.withColumn("part", _part()).join(_in_parts(hub), ["bucket", "part"]).filter("hub <> k").groupBy("hub", F.col("k").alias("spoke")).count().select("hub", "spoke")
    about = classes.select("k", "n", "bands")
    at_hub, at_spoke = (about.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"b_{x}")) for x in ("hub", "spoke"))
    near = star.join(at_spoke, "spoke").join(at_hub, "hub").select("hub", "spoke", pandas_udf(_estimate, "double")("b_hub", "b_spoke", "n_hub", "n_spoke").alias("near"))
    first = stored(near.filter("near IS NOT NULL").groupBy("spoke").agg(F.max_by("hub", F.struct("near", "hub")).alias("hub")), "first")

    def sets_of(ks: DataFrame) -> DataFrame:
        wanted = classes.join(ks, "k", "left_semi").select("k", "rep.doc", "rep.t")
        once = _texts(docs).join(wanted, ["doc", "t"]).groupBy("k").agg(F.first("text").alias("text"))  # a row may be repeated
        return stored(once.mapInPandas(_sets(width), "k long, hashes binary"), "sets")

    sets = sets_of(first.select(F.col("hub").alias("k")).union(first.select("spoke")).distinct())
    label = stored(weighed.select(F.col("k").alias("id")).distinct().withColumn("comp", F.col("id")), "label")
    label = merged(label, _links(first.select("hub", "spoke"), sets))
    release(sets)

    met, mixed = _meetings(weighed, label, about)
    open_ = stored(met.mapInPandas(_screened, "k long").distinct(), "open")
    release(mixed)
    if not open_.isEmpty():
        sets = sets_of(open_)
        fine = sets.mapInPandas(_fine, "k long, fine array<bigint>").groupBy("k").agg(F.first("fine").alias("fine"))
        about = stored(about.join(fine, "k"), "about")
        tested = first.select(F.least("hub", "spoke").alias("a"), F.greatest("hub", "spoke").alias("b"))
        for best_only in (True, False):
            met, mixed = _meetings(weighed, label, about)
            met = met.mapInPandas(_candidates(best_only), "a long, b long")
            pairs = stored(met.distinct().join(tested, ["a", "b"], "left_anti"), "candidates")
            release(mixed)
            if pairs.isEmpty():
                continue
            links = _links(pairs.select(F.col("a").alias("hub"), F.col("b").alias("spoke")), sets)
            comp = lambda x: label.select(F.col("id").alias(x), F.col("comp").alias(f"c_{x}"))  # noqa: E731, B023
            label = merged(label, links.join(comp("a"), "a").join(comp("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())
            tested = tested.union(pairs)
        release(sets, about)

    # written before they are joined by component, so that the join may split the rows of a large component
    whole = stored(classes.join(label, F.col("k") == F.col("id"), "left").select("k", "least", F.coalesce("comp", "k").alias("comp")), "whole")
    ids = stored(whole.groupBy("comp").agg(F.min("least").alias("comp_id")), "ids")
    of_class = stored(whole.join(ids, "comp").select("k", F.col("least").alias("class_id"), "comp", "comp_id"), "of_class")
    release(classes, weighed, first, label, whole, ids)
    return signed.select("doc", "t", "n", "k").join(of_class, "k", "left")


def groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each document: doc_id, n_shingles, class_id (the smallest doc_id with an equal set) and component_id."""
    doc = F.nullif("doc", F.lit(NULL_ID))
    own = lambda name: F.when(F.col("k").isNull(), doc).otherwise(F.col(name))
    return _grouped(docs, width).select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), own("class_id").alias("class_id"), own("comp_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """The contract's digest: doc_id, n_shingles, component_id, kept; class_id follows."""
    found = groups(docs, width)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows that stay, with all their columns: of each group one row, that of the smallest doc_id (null ids last), among
    texts of one id the one whose hash is smallest, once if it is repeated; and every row with an empty set."""
    found = stored(_grouped(docs, width).filter("k IS NOT NULL").groupBy("comp", "doc", "t").agg(F.count("*").alias("times")), "rows")
    best = stored(found.groupBy("comp").agg(F.min(F.struct((F.col("doc") == NULL_ID).alias("none"), "doc", "t")).alias("best")), "best")
    marked = stored(found.join(best, "comp").select("doc", "t", "times", ((F.col("doc") == F.col("best.doc")) & (F.col("t") == F.col("best.t"))).alias("kept")), "marked")
    release(found, best)
    d, t = unused(docs, "__d"), unused(docs, "__t")
    keyed = docs.withColumns({d: id_or_null(), t: F.xxhash64("text")})
    named = lambda rows: rows.select(F.col("doc").alias(d), F.col("t").alias(t))
    # most rows are neither dropped nor repeated: only those are looked up, and only repeated ones meet in an aggregate
    once = keyed.join(named(marked.filter("NOT kept OR times > 1")), [d, t], "left_anti")
    again = keyed.join(named(marked.filter("kept AND times > 1")), [d, t], "left_semi").dropDuplicates([d, t])
    return once.union(again).select(docs.columns)
