"""Query for media columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from philolog.llm.media import to_wav


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the fingerprint itself as `pairs`; the sound is written and read back, and goes along if to_wav() keeps it."""
    return to_wav(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False).drop("media")


QUERIES = {"op8_media_columns": op8_media_columns}
ORACLES: dict[str, str] = {}
