"""The queries of this folder's operators over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gramloom.llm import exact_dedup, licenses, mixing, near_dedup, packing, pii, quality, rnn_lm, sstable, topk
from gramloom.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_rnn_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnn_lm.score(table(spark, sf_dir, "documents"))


def op4_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_block_max_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_exact_dedup, op3_rnn_lm_scores, op4_crf_pii, op5_prob_minhash, op6_mixing, op7_best_fit_packing, op8_block_max_top_k, op9_co_training, op10_sstable)}

ORACLE_SQL = {
    "op1_license_scan": licenses.oracle_sql(),
    "op2_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id NULLS LAST) AS place
  FROM n
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM w
""",
    "op6_mixing": r"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [3e0, 1e0, 2e0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM r GROUP BY source
), f AS (
  SELECT source, n, w, n * 2e0 AS cap, n * 2e0 / w AS full_at, sum(n) OVER () * 1.5e0 AS budget, sum(w) OVER () AS all_w,
         coalesce(sum(n * 2e0) OVER o, 0e0) AS cap_before, coalesce(sum(w) OVER o, 0e0) AS w_before
  FROM s WINDOW o AS (ORDER BY n * 2e0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, max(CASE WHEN (budget - cap_before) / (all_w - w_before) <= full_at THEN (budget - cap_before) / (all_w - w_before) END) OVER () AS level FROM f
), t AS (
  SELECT source, n, least(cap, coalesce(level * w, cap)) AS target FROM l
), u AS (
  SELECT source, n, target, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT r.doc_id, r.source, r.size, u.n, u.target, u.whole, u.target - u.whole * u.n AS rest, r.h,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h, r.doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS run
  FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, source, size, n AS source_size, target, CAST(size * (whole + CASE WHEN run - size / 2e0 <= rest AND run - size <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
""",
    "op8_block_max_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
""",
}
