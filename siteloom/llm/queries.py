"""The corpus operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from siteloom.llm import decontaminate, html_text, language_id, licenses, line_dedup, mixing, near_dedup, personal_data, secrets, top_k


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict:
    return {
        "op1_html_text": lambda spark, d: html_text.extract(spark.read.parquet(f"{d}/pages.parquet")),
        "op2_secrets": lambda spark, d: secrets.secret_digest(_docs(spark, d)),
        "op3_benchmark_passages": lambda spark, d: decontaminate.contaminated(_docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
        "op4_personal_data": lambda spark, d: personal_data.personal_data_digest(_docs(spark, d)),
        "op5_language_id": lambda spark, d: language_id.language_of_documents(_docs(spark, d)),
        "op6_line_dedup": lambda spark, d: line_dedup.line_digests(_docs(spark, d)),
        "op7_licenses": lambda spark, d: licenses.license_labels(_docs(spark, d)),
        "op8_top_k": lambda spark, d: top_k.top_k(spark.read.parquet(f"{d}/embeddings.parquet")),
        "op9_mixing": lambda spark, d: mixing.mix_digest(_docs(spark, d)),
        "op10_near_duplicates": lambda spark, d: near_dedup.near_duplicates(_docs(spark, d)),
    }


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_WS}), '{_UP}', '{_LOW}') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.pos, l.line, (s.k IS NOT NULL AND l.doc_id <> s.stays) AS gone FROM keyed l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


#: Classes of equal shingle sets, links between classes by their common shingles, then everything reachable.
OP10 = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s
  FROM split),
docs AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY sha256(array_to_string(s, chr(10)))) END AS c FROM sets),
grams AS (SELECT d.c, d.n, unnest(s) AS g FROM sets JOIN docs d USING (doc_id) WHERE d.doc_id = d.c),
links AS (
  SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b ON a.g = b.g AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT c AS a, c AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS c, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, m AS component_id, d.doc_id = m AS kept, d.c AS class_id FROM docs d JOIN least USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6, "op8_top_k": OP8, "op10_near_duplicates": OP10}
