"""Query for hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from philolog.llm.hard_negatives import mine


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), "vec_id % 50 = 0")


_OP13 = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, a.q AS aq, x.vec_id, x.label, x.q, CAST(coalesce(list_sum(list_transform(list_zip(a.q, x.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v x ON len(a.q) = len(x.q) AND (a.vec_id <> x.vec_id OR a.label <> x.label OR a.q <> x.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, own, aq ORDER BY score DESC, vec_id, q) AS slot FROM s WHERE own = label QUALIFY slot <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.own, p.aq, p.slot ORDER BY s.score DESC, s.vec_id, s.q) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own = p.own AND s.aq = p.aq AND s.label <> s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": _OP13}
