"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import test_operators as brute

from siteloom.llm.common import stored


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "benchmark", "mixing"]
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    language, lines, near, bench, mix = tables[1:]
    assert all(t.columns == docs.columns for t in tables[1:-1])
    assert language.count() == docs.count()  # every document of this corpus has words of a language
    assert {r.doc_id for r in lines.select("doc_id").collect()} == {r.doc_id for r in language.select("doc_id").collect()}
    want = {d for d, n, c in brute._groups(brute._rows(lines), 5) if d == c}
    assert {r.doc_id for r in near.select("doc_id").collect()} == want
    assert 0 < near.count() - bench.count() < 0.1 * near.count()
    assert mix.count() == bench.count() and {"text", "taken", "target"} < set(mix.columns)


def test_stages_keep_other_columns(spark, sf):
    rows = brute._texts()
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, 4, 5, 6, 7) for r in rows], brute.SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), sf).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert set(docs.columns) < set(mixed.columns) and mixed.count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_language_stage_without_languages(spark, sf):
    """Where nothing can be learned, nothing is rejected."""
    docs = spark.createDataFrame([(k, "some words of a text", None, None, 20) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language_stage(spark, docs, sf).count() == 20


def test_language_stage_drops_unlearned_scripts(spark, sf):
    """Texts in scripts or letters never learned go; documents of the corpus stay, and short pieces of them as well."""
    rng = np.random.default_rng(6)
    scripts = [range(0x430, 0x450), range(0x3B1, 0x3CA), range(0x4E00, 0x9000), range(0xAC00, 0xD7A0), range(0x627, 0x64A), range(0xE01, 0xE2F)]
    word = lambda s: "".join(map(chr, rng.choice(list(s), rng.integers(2, 9))))
    foreign = [" ".join(word(s) for _ in range(200)) for s in scripts for _ in range(40)]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in table.select("text").collect()]
    short = [" ".join(t.split()[2:17]) for t in texts if t and len(t.split()) > 40][:300]
    rows = [(10**6 + 4 * k, t, None, "a", len(t)) for k, t in enumerate(foreign)] + [(2 * 10**6 + k, t, None, "a", len(t)) for k, t in enumerate(short)]
    added = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.language_stage(spark, table.select(added.columns).union(added), sf).select("doc_id").collect()]
    assert sum(k < 10**6 for k in kept) == len(texts)
    assert sum(10**6 <= k < 2 * 10**6 for k in kept) == 0
    assert sum(k >= 2 * 10**6 for k in kept) >= 0.98 * len(short)


def test_driver_collects_garbage_between_steps(spark):
    """A step that ends with a large heap lets go of what steps before it left, old objects included."""
    jvm = spark.sparkContext._jvm
    runtime, gateway = jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway
    left = jvm.java.util.ArrayList()
    jvm.java.lang.System.gc()
    jvm.java.lang.System.gc()  # no longer young, so no small collection takes it
    weak = jvm.java.lang.ref.WeakReference(left)
    held = []
    while runtime.totalMemory() <= 0.6 * runtime.maxMemory():
        held.append(gateway.new_array(gateway.jvm.int, 4 << 20))
    gateway.detach(left)
    assert not weak.refersTo(None)
    stored(spark.range(10), "step")
    assert weak.refersTo(None)
