"""Queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from philolog.llm import queries_groups, queries_language, queries_media, queries_merges, queries_mixing, queries_negatives, queries_pii, queries_quality, queries_tokens, queries_trie

_MODULES = (queries_groups, queries_language, queries_media, queries_merges, queries_mixing, queries_negatives, queries_pii, queries_quality, queries_tokens, queries_trie)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
