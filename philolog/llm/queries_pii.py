"""Query for personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from philolog.llm.pii import find_personal


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
