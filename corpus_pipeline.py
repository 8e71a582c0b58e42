"""Documents to a training mix: language, shared lines, near duplicates, benchmark passages, mixing.

Every stage takes all rows the one before kept and is written as Parquet in between. All but the last return the columns of
documents, whatever other columns these have; the last adds size, source_size, target and taken to them.

Nulls and edge cases: null texts are of no language, so they go where a language is learned; null ids, sources and langs are
values like others; repeated rows are one group of near duplicates, of which one row stays; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from siteloom.llm.common import stored, unused


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose likeness to every language learned is no more than noise, go. Where no document
    has a language to learn from, nothing can be told and all stay."""
    prototypes = language_id.fit(docs)
    if not prototypes:
        return docs
    found = unused(docs, "__language")
    least = language_id.least_scores(language_id.training(docs), prototypes)
    return language_id.identify(docs, prototypes, out=found).filter(language_id.is_like(found, least)).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go; n_chars follows the text. A text that loses nothing, null included, stays as it is."""
    lines = unused(docs, "__lines")
    changed = line_dedup.without_shared_lines(docs, out=lines)
    lost = F.col(f"{lines}.n_dropped") > 0
    text = F.when(lost, F.col(f"{lines}.kept")).otherwise(F.col("text"))
    chars = F.when(lost, F.length(f"{lines}.kept")).otherwise(F.col("n_chars")).cast("long")
    return changed.withColumns({"text": text, "n_chars": chars}).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest id stays; rows without words are in no group and stay."""
    return near_dedup.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null texts hold none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, text included, with the words that the mix takes of it; of a wordless one it takes none."""
    return mixing.with_taken(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]

#: Language scores and similarity groups are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
