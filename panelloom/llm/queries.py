"""Queries over the corpus tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import (
    bpe_counts,
    collocations,
    divergence,
    genetic_packing,
    licences,
    mixing,
    near_dedup,
    near_vectors,
    packed_ids,
    suffix_dedup,
    topk_cells,
    toxicity,
    vantage,
)
from panelloom.llm.common import vocabulary_path

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licence_scan(table(spark, sf_dir, "documents"))
    return found.withColumns(
        {c: F.concat_ws(" ", c) for c in ("sentences", "licences")}
    ).withColumn("declared", F.concat_ws(", ", "declared"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_cells.exact_top_k(table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.token_counts(
        table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY), limit=1024
    )


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)
    return mixed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packed_ids.packed_documents(
        table(spark, sf_dir, "documents"), vocabulary_path(WORD_VOCABULARY), end_id=2
    )
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic_packing.pack_documents(
        table(spark, sf_dir, "documents"), vocabulary_path(WORD_VOCABULARY), size=2048, end_id=0
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_topk": op2_exact_topk,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_source_mix": op5_source_mix,
    "op6_near_dedup": op6_near_dedup,
    "op7_vantage_search": op7_vantage_search,
    "op8_packed_ids": op8_packed_ids,
    "op9_genetic_packing": op9_genetic_packing,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_near_vectors": op12_near_vectors,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLES: dict[str, str] = {
    "op11_source_divergence": divergence.divergence_sql(),
    "op12_near_vectors": near_vectors.NEAR_VECTORS_SQL,
    "op13_phrase_collocations": collocations.collocations_sql(),
    "op1_license_scan": licences.licence_sql(),
    "op2_exact_topk": """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op5_source_mix": r"""
WITH sizes AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         3.0::DOUBLE * source_size AS most
  FROM totals
),
-- Clamped sources are those with the smallest most / w; the level after clamping j of them.
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED
               PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND
               UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY most / w, source)
),
fill AS (SELECT max(level) AS level FROM levels WHERE level * w <= most),
targets AS (
  SELECT source, source_size, least(w * coalesce((SELECT level FROM fill), 0), most) AS target
  FROM weighed
),
ordered AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT)
              ELSE 0 END AS copies,
         coalesce(sum(s.size) OVER (PARTITION BY s.source
           ORDER BY md5('mix-1:' || CAST(s.doc_id AS VARCHAR)), s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(copies * size + greatest(0, least(
         CAST(round(target) AS BIGINT) - copies * source_size - before, size)) AS BIGINT) AS taken
FROM ordered""",
    "op7_vantage_search": """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
