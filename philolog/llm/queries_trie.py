"""Query for the trie of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from philolog.llm._session import stored
from philolog.llm.prefix_trie import coded_turns, prefix_trie

#: A conversation is rebuilt on the first of its group of so many ids; it shares fewer turns with it than SHARED.
GROUP, SHARED = 20, 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, code, words) of the rebuilt conversations, and all conversations (conv_id)."""
    sizes = stored(turns.groupBy("conv_id").agg(F.max("place").alias("n")))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    convs = stored(convs.withColumn("used", F.least("h", F.coalesce("there", F.lit(0)))))
    heads = turns.where(F.col("place") < SHARED).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "used"), "base").where("place <= used")
    tails = turns.join(convs.select("conv_id", "h", "used"), "conv_id").where("place > h").withColumn("place", F.col("used") + F.col("place") - F.col("h"))
    columns = ["conv_id", "place", "code", "words"]
    return stored(heads.select(columns).unionByName(tails.select(columns))), convs.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(coded_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_OP12 = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
own AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(code ORDER BY place) AS codes, list(words ORDER BY place) AS words FROM own GROUP BY conv_id),
h AS (
  SELECT conv_id, codes, words, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 4 AS h
  FROM lists, t),
r AS (
  SELECT a.conv_id, list_concat(coalesce(b.codes[1:a.h], []), a.codes[a.h + 1:]) AS codes, list_concat(coalesce(b.words[1:a.h], []), a.words[a.h + 1:]) AS words
  FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 20),
m AS (SELECT conv_id, codes, words, unnest(range(len(codes) + 1)) AS depth FROM r),
p AS (SELECT conv_id, depth, codes[1:depth] AS path, codes[1:greatest(depth - 1, 0)] AS up, CASE WHEN depth = 0 THEN 0 ELSE words[depth] END AS w, depth = len(codes) AS ends FROM m),
n AS (
  SELECT min(conv_id) AS conv_id, depth, path, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
c AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
a AS (SELECT depth, path, n_children, saved, unnest(range(depth + 1)) AS above FROM c),
s AS (SELECT above AS depth, path[1:above] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY ALL)
SELECT c.conv_id, c.depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM c JOIN s USING (depth, path) LEFT JOIN n u ON u.depth = c.depth - 1 AND u.path = c.up
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": _OP12}
