"""Retrieval: chunks, BM25, exact dense search, rank fusion, and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from philolog.functions import cutting
from philolog.functions import text as X

#: Fixed: term saturation, its numerator, length weight, and the constant of rank fusion.
SATURATION, NUMERATOR, LENGTH_WEIGHT, FUSION = 1.2, 2.0, 0.75, 60


def build_chunks(documents: DataFrame) -> DataFrame:
    """chunk_id, document_id, language, chunk_no, text of whole paragraphs cut at natural ends."""
    parts = documents.select("doc_id", "lang", F.posexplode(X.paragraphs(F.coalesce("text", F.lit("")))).alias("p", "paragraph"))
    rows = parts.select("doc_id", "lang", "p", F.posexplode(X.chunks("paragraph")).alias("c", "text"))
    return rows.select(F.concat_ws(":", F.lit("paragraph"), "doc_id", "p", "c").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("language"), F.col("c").cast("long").alias("chunk_no"), "text", F.sha2("text", 256).alias("text_sha256"))


def pair_chunks(pairs: DataFrame) -> DataFrame:
    text = F.concat(F.lit("[ZH] "), F.col("a_text"), F.lit("\n[EN] "), F.col("b_text"))
    return pairs.select(F.concat_ws(":", F.lit("pair"), "pair_no").alias("chunk_id"), F.lit("zh_en").alias("language"), text.alias("text"), F.sha2(text, 256).alias("text_sha256"))


def bm25(chunks: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of chunks that hold a query term; a term counts once in the query.

    Terms are counted and their parts added in the order of the query within a chunk's own row, so
    reruns give the same sums; only one row of totals is shuffled.
    """
    session = chunks.sparkSession
    wanted = [r[0] for r in session.range(1).select(F.explode(F.array_distinct(X.retrieval_terms(F.lit(query))))).collect()]
    if not wanted:
        return chunks.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where(F.lit(False))
    own = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = own.mapInArrow(_counter(wanted), f"id {own.schema['id'].dataType.simpleString()}, length int, " + ", ".join(f"tf_{k} int" for k in range(len(wanted))))
    totals = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf_{k}") > 0).cast("long")).alias(f"df_{k}") for k in range(len(wanted))])
    rows = counts.where(F.greatest(*[F.col(f"tf_{k}") for k in range(len(wanted))], F.lit(0)) > 0).crossJoin(F.broadcast(totals))  # one row
    relative = F.when(F.col("mean") > 0, F.col("length") / F.col("mean")).otherwise(1.0)
    score = F.lit(0.0)
    for k in range(len(wanted)):
        tf, df = F.col(f"tf_{k}"), F.col(f"df_{k}")
        score = score + F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * NUMERATOR / (tf + SATURATION * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * relative))
    return rows.select("id", score.alias("score")).where("score > 0")


def _counter(wanted: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over id, text: how many of text.retrieval_terms() a text has, and how often each wanted one."""
    names = ["id", "length", *[f"tf_{k}" for k in range(len(wanted))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("text").cast("binary").to_pylist():
                text = (raw or b"").decode("utf-8", "replace")
                terms = [w for t in cutting.finder(text)(text) if len(w := t.casefold()) > 1 and w.isalnum()]
                rows.append((len(terms), *map(terms.count, wanted)))
            columns = zip(*rows, strict=True) if rows else [()] * (1 + len(wanted))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int32()) for c in columns]], names=names)

    return run


def dense_search(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", *, language: str = "", language_col: str = "language") -> DataFrame:
    """The k vectors of greatest cosine (exact), ties by id; vectors of another length or without one are passed over.

    With a language, those of it and of pairs (zh_en) are searched.
    """
    vectors = vectors.where(F.col(language_col).isin(language, "zh_en")) if language else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector_col, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    scored = vectors.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), dot.alias("d"), norm.alias("n")).where("n > 0")
    return ranked_scores(scored.select("id", (F.col("d") / (F.col("n") * length)).alias("score")), k)


def ranked_scores(scores: DataFrame, k: int) -> DataFrame:
    """The k best of scored rows; scores count to nine digits, so that sums in another order don't part ties."""
    return scores.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(k)


def ranks(scores: DataFrame, name: str) -> DataFrame:
    """id and rank by score, ties by id; for lists already cut to what is wanted."""
    return scores.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias(name))


def fuse(semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two scored lists: id, semantic_rank, lexical_rank, score."""
    both = ranks(semantic, "semantic_rank").join(ranks(lexical, "lexical_rank"), "id", "full_outer")
    part = lambda c: F.when(F.col(c).isNotNull(), 1 / (FUSION + F.col(c))).otherwise(0.0)
    return both.withColumn("score", part("semantic_rank") + part("lexical_rank")).orderBy(F.desc("score"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("lexical_rank"), "id").limit(k)


def evaluate(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row: cases, recall, mrr, hit_rate, p95_ms. results: case_id, rank, id, latency_ms; expected: case_id, id."""
    hits = results.where(F.col("rank") <= k).join(expected, ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.countDistinct("id").alias("found"), F.min("rank").alias("first"))
    cases = expected.groupBy("case_id").agg(F.countDistinct("id").alias("wanted")).join(hits, "case_id", "left")
    latency = results.groupBy("case_id").agg(F.max("latency_ms").alias("latency_ms"))
    cases = cases.join(latency, "case_id", "left")
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"), F.avg(F.when(F.col("first").isNotNull(), 1 / F.col("first")).otherwise(0.0)).alias("mrr"),
        F.avg(F.col("first").isNotNull().cast("double")).alias("hit_rate"), F.expr("cast(percentile_disc(0.95) within group (order by coalesce(latency_ms, 0)) as long)").alias("p95_ms"),
    )


def stale(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose stored vector is missing or belongs to another text."""
    return chunks.join(stored.select("chunk_id", F.col("text_sha256").alias("_sha")), "chunk_id", "left").where("_sha is null or _sha != text_sha256").drop("_sha")


def valid_vector(vector: Column, dim: int) -> Column:
    """Of the right length, finite, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)
