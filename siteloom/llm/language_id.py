"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram of three letters is bound by multiplying the letters' vectors,
each permuted (rotated) by its place; a text is the bundle (sum) of its n-gram vectors; a language's prototype is the
bundle of its training texts. A text takes the language whose prototype has the highest cosine.

Nulls and edge cases: a null, empty or letterless text is `und` with score 0; with no training row every text is; a null
doc_id is neither held out nor learned from; texts are read whole; equal cosines go to the language first by code point;
repeated rows are rows of their own; extra columns pass through `identify` untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siteloom.llm.common import small_batches

DIMENSIONS = 1024
#: Letter vectors: 0 is the gap between words, 1-26 are a-z, the next SHARED are for the letters of each script of thousands
#: (ideographs, then Hangul), whose n-grams would else hardly recur; other letters have the rest. All go by a hash of their
#: code point, so letters of an alphabet seldom share one and those of different scripts of thousands never do.
SLOTS = 4096
SHARED = 64
BITS = 12  # of a slot's number in an n-gram's code
SEED = 20240229
#: Languages whose n-grams a task gathers at once, and n-grams of a language that are bundled at a time (2 MB each).
OPEN_LANGUAGES = 32
OPEN_NGRAMS = 1 << 18
UNKNOWN = "und"
#: Cosines of unlike texts scatter by NOISE whatever their length: none is a likeness up to twice that, any from four times on.
NOISE = DIMENSIONS**-0.5
CLEAR = 4 * NOISE
#: The part of the training texts of a size that may have less likeness than a text of that size must have; texts that tell.
LEAST, ENOUGH = 0.001, 10

_tables: list = []


def _letters() -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Slot of every code point, and the letters' vectors rotated for each of the three places."""
    if not _tables:
        slot = np.zeros(0x110000, np.uint16)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = ord(char.lower()[0])
                hashed = low * 2654435761 >> 12
                if 97 <= low <= 122:
                    slot[point] = low - 96
                elif 0x3400 <= low < 0xA000 or 0xF900 <= low < 0xFB00 or low >= 0x20000:
                    slot[point] = 27 + hashed % SHARED
                elif 0xAC00 <= low < 0xD7B0:
                    slot[point] = 27 + SHARED + hashed % SHARED
                else:
                    slot[point] = 27 + 2 * SHARED + hashed % (SLOTS - 27 - 2 * SHARED)
        vectors = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SLOTS, DIMENSIONS))
        _tables.append((slot, tuple(np.roll(vectors, k, axis=1) for k in (2, 1, 0))))
    return _tables[0]


def ngrams(text: str | None) -> np.ndarray:
    """Codes of the letter trigrams, runs of other characters being one gap; empty if there is no letter."""
    slot, _ = _letters()
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = np.zeros(1, np.uint16)
    s = np.concatenate((gap, slot[points], gap))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))].astype(np.int64)
    if len(s) < 3:
        return np.zeros(0, np.int64)
    return s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:]


def _bound(c: np.ndarray) -> np.ndarray:
    """The n-grams' vectors: the letters' rotated ones, multiplied."""
    _, (first, second, third) = _letters()
    return first[c >> 2 * BITS] * second[c >> BITS & SLOTS - 1] * third[c & SLOTS - 1]


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the n-grams' vectors, each as often as it occurs."""
    total = np.zeros(DIMENSIONS)
    for at in range(0, len(codes), 4096):
        bound = _bound(codes[at : at + 4096])
        total += counts[at : at + 4096].astype(np.float32 if counts.max() < 4096 else float) @ bound.astype(np.float32)
    return total


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from rows of (text, lang), all of them; to the driver come only languages x DIMENSIONS sums."""

    small_batches(labelled.sparkSession)

    def profiles(batches):
        sums: dict[str, np.ndarray] = {}
        open_: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def close(lang):
            codes, counts = np.unique(np.concatenate(open_.pop(lang)), return_counts=True)
            sums[lang] = sums.get(lang, 0) + np.rint(_exact(codes, counts)).astype(np.int64)
            del sizes[lang]

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if lang not in open_ and len(open_) >= OPEN_LANGUAGES:
                    close(max(sizes, key=sizes.get))
                codes = ngrams(text)
                open_.setdefault(lang, []).append(codes)
                sizes[lang] = sizes.get(lang, 0) + len(codes)
                if sizes[lang] >= OPEN_NGRAMS:
                    close(lang)
        for lang in list(open_):
            close(lang)
        yield pd.DataFrame({"lang": pd.Series(list(sums), dtype=object), "sums": pd.Series(list(sums.values()), dtype=object)})

    rows = (
        labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
        .mapInPandas(profiles, "lang string, sums array<bigint>")
        .select("lang", F.posexplode("sums").alias("at", "value"))
        .groupBy("lang", "at").agg(F.sum("value").alias("value"))
        .collect()
    )
    prototypes: dict[str, np.ndarray] = {}
    for row in rows:
        prototypes.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["at"]] = row["value"]
    return {lang: v / n for lang, v in sorted(prototypes.items()) if (n := np.linalg.norm(v)) > 0}


def _exact(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """As bundle(), in integers: sums over any split of the corpus agree to the last digit."""
    total = np.zeros(DIMENSIONS)
    for at in range(0, len(codes), 4096):
        total += counts[at : at + 4096].astype(float) @ _bound(codes[at : at + 4096]).astype(float)
    return total


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", out: str = "language") -> DataFrame:
    """docs with a column `out`: struct of lang_pred, score (the cosine, 0 to 1) and n (different n-grams of the text)."""
    small_batches(docs.sparkSession)
    langs = list(prototypes)
    matrix = np.stack(list(prototypes.values())) if langs else np.zeros((0, DIMENSIONS))

    @pandas_udf("lang_pred string, score double, n long")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = []
        for t in texts:
            codes, counts = np.unique(ngrams(t), return_counts=True)
            if not len(codes) or not langs:
                found.append((UNKNOWN, 0.0, len(codes)))
                continue
            v = bundle(codes, counts)
            near = matrix @ v / max(np.linalg.norm(v), 1e-12)
            best = int(near.argmax())
            found.append((langs[best], float(min(1.0, max(0.0, near[best]))), len(codes)))
        return pd.DataFrame(found, columns=["lang_pred", "score", "n"])

    return docs.withColumn(out, predict(F.col(text)))


def training(docs: DataFrame) -> DataFrame:
    """text and lang of all documents that are not held out."""
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang")


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from all documents that are not held out; only text and lang are learned from."""
    return learn(training(docs))


def _size(found: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(f"{found}.n"), F.lit(1)))).cast("int")


def least_scores(labelled: DataFrame, prototypes: dict[str, np.ndarray]) -> dict[int, float]:
    """For each size of text (powers of two of its different n-grams) the least score of a likeness, from all rows of (text, lang).

    It is CLEAR, or for texts too short to reach that always, the LEAST quantile of the scores of the training texts. Sizes
    with less than ENOUGH of them are taken with the smaller ones; with less than 1 / LEAST, NOISE is left as slack.
    """
    found = identify(labelled.filter("text IS NOT NULL AND lang IS NOT NULL"), prototypes, out="__found")
    found = found.filter(F.col("__found.lang_pred") != UNKNOWN).groupBy(_size("__found").alias("size"))
    low = F.percentile_approx("__found.score", LEAST, 10_000).alias("low")
    rows = {r["size"]: r for r in found.agg(F.count("*").alias("n"), low).collect()}  # one row for each size
    least = {}
    for size in range(SLOTS.bit_length() * 3):
        n, score = 0, CLEAR
        for k in range(size, -1, -1):
            if k in rows and n < ENOUGH:
                n, score = n + rows[k]["n"], min(score, rows[k]["low"] - (NOISE if rows[k]["n"] < 1 / LEAST else 0))
        least[size] = max(score, 2 * NOISE) if n else 2 * NOISE
    return least


def is_like(found: str, least: dict[int, float]) -> Column:
    """Whether the struct `found` of identify() is a likeness to a learned language."""
    limit = F.lit(CLEAR)
    for size, score in sorted(least.items()):
        limit = F.when(_size(found) == size, F.lit(score)).otherwise(limit)
    return (F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") > 0) & (F.col(f"{found}.score") >= limit)


def language_of_documents(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
