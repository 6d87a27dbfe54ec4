"""Rows of exports: concordance lines with their places, and occurrences in pairs, whole and in order."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from philolog.operators import ordering, parallel
from philolog.operators.concordance import Kwic, sort_columns

#: Fixed: columns of an exported line, and what an export of pairs remembers of its query.
LINE = ("left", "keyword", "right", "filename", "paragraph_no", "sentence_no", "L3", "L2", "L1", "R1", "R2", "R3")
PAIR_FIELDS = ("q", "side", "a_has", "b_has", "a_lacks", "b_lacks", "alignment_unit", "whole_words", "case_sensitive", "every")


def with_metadata(hits: DataFrame, documents: DataFrame, *columns: str) -> DataFrame:
    """Hits with columns of their documents (doc_id, ...)."""
    return hits.join(documents.select(F.col("doc_id").alias("document_id"), *columns), "document_id", "left")


def line_rows(query: Kwic, documents: DataFrame, filename_col: str = "filename") -> DataFrame:
    """All lines of a concordance in its order, with file, paragraph and sentence; nothing is paged."""
    hits = with_metadata(query.hits(documents, places=True), documents, F.col(filename_col).alias("filename"))
    ordered = hits.orderBy(*sort_columns(query.sort_keys, query.by_frequency))
    return ordered.select(F.col("left_context").alias("left"), "keyword", F.col("right_context").alias("right"), *LINE[3:])


def occurrence_rows(pairs: DataFrame, query: parallel.PairQuery, sort_keys: list[str] | None = None) -> DataFrame:
    """All occurrences of a query in pairs, every k-th taken before they are ordered."""
    rows = parallel.occurrences(pairs, query)
    if sort_keys:
        rows = parallel.with_context(rows, query)
    columns = [c for c in ("pair_no", "pair_id", "occurrence_ordinal", "filename", "a_text", "b_text", "alignment_unit", "method", "confidence") if c in rows.columns]
    return rows.orderBy(*ordering.occurrences(sort_keys or [])).select(*columns)


def remembered(query: parallel.PairQuery, sort_keys: list[str] | None = None) -> dict:
    """A pair query as an export keeps it: bounds on files and confidence, and the width of contexts, are left out."""
    known = {f.name: getattr(query, f.name) for f in fields(query)}
    places = [*(sort_keys or []), "", "", ""][:3]
    return {k: known[k] for k in PAIR_FIELDS} | {f"sort_{i + 1}": k for i, k in enumerate(places)}
