"""Queries for groups of alike rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from philolog.llm.shingle_join import shingle_groups
from philolog.llm.vector_dups import near_vectors


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+3], ' ') for i in range(1, len(ws) - 2)]) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = s.doc_id) AS component_id FROM s
"""

def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND list_max([abs(x) for x in embedding]) > 0),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT c.x AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.x = component_id AS kept FROM c LEFT JOIN n ON n.x = c.x
"""

QUERIES = {"op9_embedding_near_dedup": op9_embedding_near_dedup, "op4_ngram_jaccard_join": op4_ngram_jaccard_join}
ORACLES = {"op9_embedding_near_dedup": _OP9, "op4_ngram_jaccard_join": _OP4}
