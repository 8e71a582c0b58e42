"""Licence notices by a positional index of rare words, in DataFrame expressions only.

Words of the notices' templates, without stop words, are ranked by inverse document frequency over all documents. The
index holds the KEY_WORDS rarest words of each template's mandatory phrase with their postings (template, position). They
are looked up wherever they occur in a file; each occurrence and posting gives a template and the place where the template
would begin. Places that two occurrences agree on are intersected postings; there the mandatory phrase is compared word by
word. A phrase that stands in a file has all its words there, so no place is missed. The score is the greatest part of a
confirmed template's words that stand at their places.

Nulls and edge cases: a null or empty text has no word, no label and score 0; words are whole-text positions from 0;
labels are distinct and in order; repeated rows are rows of their own; a null doc_id is returned; extra columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base: phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices: label, template, mandatory phrase.
TEMPLATES = (
    ("agpl", "this work is licensed under the gnu affero general public license version 3", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright and related"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy modify"),
    ("lgpl", "this work is licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
STOP_WORDS = frozenset("a all and any are for has in into is of or the this to with without use under free 0 2 3 4 by person".split())
#: Words looked up for each template: as many as must agree on a place.
KEY_WORDS = 2
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHIFT, _START = 1 << 40, 1 << 30  # a vote is template * _SHIFT + start of the template + _START, as one long

_SPLIT = [(label, t.split(), p.split()) for label, t, p in TEMPLATES]
INDEX = sorted({w for _, t, _ in _SPLIT for w in t} - STOP_WORDS)


def folded(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(F.coalesce(text, F.lit("")), _UP, _LOW)


def word_list(text: Column) -> Column:
    return F.filter(F.split(folded(text), _GAP), lambda w: w != "")


def document_frequency(docs: DataFrame) -> dict[str, int]:
    """For each index word the number of documents, of all, that hold it."""
    held = F.array_intersect(word_list(F.col("text")), F.array(*map(F.lit, INDEX)))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()  # at most one row for each index word
    return dict.fromkeys(INDEX, 0) | {r[0]: r[1] for r in rows}


def _places(words: Column, phrase: list[str]) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - len(phrase))

    def here(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    return F.when(F.size(words) >= len(phrase), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def _literal(rows, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), kind)


def scan(docs: DataFrame, frequency: dict[str, int]) -> DataFrame:
    """doc_id with the contract's columns; frequency ranks the index words, rarest first."""
    ranked = sorted(INDEX, key=lambda w: (frequency[w], w))
    keyed = [[w for w in ranked if w in phrase][:KEY_WORDS] for _, _, phrase in _SPLIT]
    looked_up = [w for w in ranked if any(w in k for k in keyed)]
    rank = {w: k for k, w in enumerate(looked_up)}
    postings = [[t * _SHIFT + _START - p for t, (_, words, _) in enumerate(_SPLIT) if w in keyed[t] for p, x in enumerate(words) if x == w] for w in looked_up]

    def spots(words: list[str], part: list[str]) -> list[dict]:
        first = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        return [{"at": first + k, "word": w} for k, w in enumerate(part)]

    text = folded(F.col("text"))
    # a text with none of these can hold neither a phrase nor an aligned template
    hint = "|".join(_GAP.join(p.split()) for p in BASE)
    hint = f"{hint}|{'|'.join(sorted({w for _, _, p in _SPLIT for w in sorted(set(p) - STOP_WORDS, key=len)[-1:]}))}"
    one = docs.select("doc_id", word_list(F.col("text")).alias("w"), text.rlike(hint).alias("hint"))

    none = F.array().cast("array<int>")
    for k, phrase in enumerate(BASE):
        one = one.withColumn(f"p{k}", F.when(F.col("hint"), _places(F.col("w"), phrase.split())).otherwise(none))
    w = F.col("w")
    hits = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(looked_up))
    one = one.withColumn("hits", F.when(F.col("hint") & (F.size(w) > 0), hits).otherwise(none))
    ranks = _literal(rank, "map<string,int>")
    one = one.withColumn("hits", F.transform("hits", lambda i: F.struct(i.alias("i"), F.element_at(ranks, F.get(w, i)).alias("r"))))
    posted = _literal(postings, "array<array<bigint>>")
    votes = F.flatten(F.transform("hits", lambda h: F.transform(F.get(posted, h["r"]), lambda v: v + h["i"])))
    one = one.withColumn("votes", F.sort_array(votes))
    again = F.filter("votes", lambda v, i: (i > 0) & (v == F.get("votes", i - 1)))
    one = one.withColumn("aligned", F.array_distinct(again))
    keys = _literal([spots(t, p) for _, t, p in _SPLIT], "array<array<struct<at:int,word:string>>>")
    whole = _literal([spots(t, t) for _, t, _ in _SPLIT], "array<array<struct<at:int,word:string>>>")

    def template(v: Column) -> Column:
        return F.floor(v / _SHIFT).cast("int")

    def start(v: Column) -> Column:
        return (F.pmod(v, F.lit(_SHIFT)) - _START).cast("int")

    def at_place(v: Column):
        return lambda s: F.coalesce((start(v) + s["at"] >= 0) & (F.get(w, start(v) + s["at"]) == s["word"]), F.lit(False))

    one = one.withColumn("sure", F.filter("aligned", lambda v: F.forall(F.get(keys, template(v)), at_place(v))))
    share = F.transform("sure", lambda v: F.size(F.filter(F.get(whole, template(v)), at_place(v))) / F.size(F.get(whole, template(v))))
    names = _literal([x[0] for x in _SPLIT], "array<string>")
    found = [F.when(F.size(f"p{k}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, label in enumerate(BASE.values())]
    base = F.concat(*found)
    start_min = F.least(*[F.array_min(f"p{k}") for k in range(len(BASE))])
    ends = [F.array_max(f"p{k}") for k in range(len(BASE))]
    return one.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        sum((F.size(f"p{k}") for k in range(1, len(BASE))), F.size("p0")).cast("long").alias("n_base"),
        start_min.cast("long").alias("first_word"),
        F.greatest(*ends).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, F.transform("sure", lambda v: F.get(names, template(v)))))), ",").alias("labels"),
        F.coalesce(F.array_max(share), F.lit(0.0)).cast("double").alias("score"),
    )


def license_labels(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return scan(docs, document_frequency(docs))
