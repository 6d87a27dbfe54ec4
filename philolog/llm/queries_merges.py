"""Query for byte-level BPE by ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from philolog.llm.byte_merges import Merges, decode, encode

#: The file of ranks in the installed public_tokenizers package.
RANKS_FILE = "byte_bpe_50k.tiktoken"


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(RANKS_FILE)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    ids = F.sha2(Merges(path).packed(F.col("ids")), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
ORACLES: dict[str, str] = {}
