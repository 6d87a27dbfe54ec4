"""Vectors of chunks, kept up to date: only what is new or has another text is embedded.

A provider turns texts into vectors, in batches within Spark's tasks. Vectors are stored with the digest
of their text and the provider's name; a run keeps those that still hold, embeds the rest, leaves out
those whose chunk is gone, and publishes all as one version. A version is published only if it has one
good vector for each chunk.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from philolog.operators.retrieval import stale, valid_vector
from philolog.sources import versions

#: Texts that a provider gets at once.
BATCH = 32
VECTORS = "chunk_id string, text_sha256 string, provider string, vector array<float>"


class Provider(Protocol):
    """Embeds texts. It travels to the workers, so it opens what it needs when it is first asked there."""

    name: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class EmbeddingError(RuntimeError):
    """A provider gave what cannot be stored, or a version would not have one vector for each chunk."""


@dataclass(frozen=True)
class HashedWords:
    """A provider without a model: counts of words and their letter triples, hashed to `dim` places, at unit length."""

    dim: int = 128
    name: str = "hashed-words-1"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.dim
        for word in re.findall(r"\w+", text.casefold()) or [""]:
            padded = f" {word} "
            for part in (word, *(padded[i : i + 3] for i in range(len(padded) - 2))):
                mark = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                out[mark % self.dim] += 1.0 if mark >> 63 else -1.0
        length = math.sqrt(sum(x * x for x in out)) or 1.0
        return [x / length for x in out] if any(out) else [1.0] + [0.0] * (self.dim - 1)


def embedded(chunks: DataFrame, provider: Provider, batch: int = BATCH) -> DataFrame:
    """Vectors (as VECTORS) of chunks (chunk_id, text, text_sha256); a null text counts as empty."""
    name, dim = provider.name, provider.dim

    def run(batches):
        for rows in batches:
            texts, out = [t or "" for t in rows.column(1).to_pylist()], []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                vectors = provider.embed(some)
                if len(vectors) != len(some) or any(len(v) != dim for v in vectors):
                    raise EmbeddingError(f"{name} gave other than {len(some)} vectors of {dim} numbers")
                out += vectors
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([name] * len(texts), pa.string()), pa.array(out, pa.list_(pa.float32()))], ["chunk_id", "text_sha256", "provider", "vector"])

    return chunks.select(F.col("chunk_id").cast("string"), F.col("text").cast("string"), "text_sha256").mapInArrow(run, VECTORS)


@dataclass(frozen=True)
class Refresh:
    """What a run did: the version, and how many chunks were embedded, kept and left out."""

    version: versions.Version
    embedded: int
    kept: int
    dropped: int


def refresh(chunks: DataFrame, folder: str, provider: Provider, *, batch: int = BATCH) -> Refresh:
    """Brings the folder's vectors up to date with chunks (chunk_id, text), whose ids are distinct and not null.

    With nothing to do no version is made. A provider of another name embeds all chunks anew.
    """
    spark = chunks.sparkSession
    own = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    counts = own.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids")).first()
    if counts["n"] != counts["ids"]:
        raise EmbeddingError("ids of chunks are null or repeated")
    before = versions.current(spark, folder)
    there = before.table(spark, "vectors") if before else spark.createDataFrame([], VECTORS)
    good = there.where((F.col("provider") == provider.name) & valid_vector(F.col("vector"), provider.dim))
    holds = good.join(own.select("chunk_id", "text_sha256"), ["chunk_id", "text_sha256"], "left_semi").select(*there.columns)
    kept, old = holds.count(), there.count()
    if before and kept == old == counts["n"]:
        return Refresh(before, 0, kept, 0)
    new = embedded(stale(own, good), provider, batch)
    version = versions.publish({"vectors": holds.unionByName(new)}, folder, after=before, check=lambda tables: _checked(tables["vectors"], counts["n"], provider))
    return Refresh(version, counts["n"] - kept, kept, old - kept)


def _checked(vectors: DataFrame, wanted: int, provider: Provider) -> None:
    found = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids"), F.coalesce(F.sum((~valid_vector(F.col("vector"), provider.dim)).cast("long")), F.lit(0)).alias("bad")).first()
    if (found["n"], found["ids"], found["bad"]) != (wanted, wanted, 0):
        raise EmbeddingError(f"{found['n']} vectors of {found['ids']} chunks, {found['bad']} of them bad, for {wanted} chunks")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version's vectors."""
    version = versions.current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"{folder} holds no vectors")
    return version.table(spark, "vectors")
