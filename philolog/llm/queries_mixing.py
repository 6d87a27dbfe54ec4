"""Query for mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from philolog.llm.mixing import mix_sources


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; op6_mixed_blocks has the texts."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).taken.select("doc_id", "size", "source_size", "target", "taken")


def op6_mixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: the text of every block by shard."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).blocks()


QUERIES = {"op6_mixing_sources": op6_mixing_sources, "op6_mixed_blocks": op6_mixed_blocks}
ORACLES: dict[str, str] = {}
