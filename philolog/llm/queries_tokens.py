"""Queries for tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from philolog.llm.automaton import score_texts
from philolog.llm.bpe import encode_decode
from philolog.llm.unigram import count_tokens

#: The vocabulary's name in the installed public_tokenizers package.
BPE_FILE = "byte_bpe_50k.json"


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe_path(), keep=())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe_path())


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    scored = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~part)
    return scored.select("doc_id", part.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_token_counts": op2_token_counts, "op3_lm_scoring": op3_lm_scoring, "op5_bpe_encoding": op5_bpe_encoding}
ORACLES: dict[str, str] = {}
