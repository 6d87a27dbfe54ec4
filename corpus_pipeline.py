"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Rows pass through whole: a stage drops or rewrites documents but knows no limits. Extra columns go
along, nulls in any column are allowed, and an empty table stays empty. Stages' tables lie in the
checkpoint folder; each is deleted as soon as the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from philolog.llm._session import checkpoints, remove
from philolog.llm.bpe import encode_decode
from philolog.llm.mixing import mix_documents
from philolog.llm.pii import redact
from philolog.llm.quality import score
from philolog.llm.queries_quality import quality_model
from philolog.llm.queries_tokens import bpe_path
from philolog.llm.shingle_join import shingle_groups


#: Words of a shingle, and the least similarity of two near copies in percent.
WIDTH, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is fitted on labelled documents of the input."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    work = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    return score(work, model).where("predicted = 1").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id; of equal ids the first in the input, and one without an id last.

    Rows go by their places in the stage's table, so ids may be null or repeated, over like texts or
    unlike ones.
    """
    work = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("place"), F.col("text"))
    groups = shingle_groups(work, "place", width=WIDTH, percent=PERCENT).select(F.col("doc_id").alias("place"), "component_id")
    ids = work.select("place", F.col("row.doc_id").cast("long").alias("id"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place"))
    first = groups.join(ids, "place").groupBy("component_id").agg(least.alias("first")).select(F.col("first.place").alias("place"))
    return work.join(first.hint("merge"), "place", "left_semi").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the text decoded from them, in place of its text.

    Other columns go along, but for those that are named like a result.
    """
    made = ("text", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    return encode_decode(docs, bpe_path(), keep=("ids",), carry=tuple(c for c in docs.columns if c not in made))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mixing),
    ("BPE encoding", encoding),
]
#: Learned models and random draws have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if last:
                remove(spark, last)
            last = f"{folder}/{k}"
    return docs
