"""Orders of result tables: columns for orderBy, ties broken to a total order.

Orders are over whole columns of a result, so they are meant for rows that a limit or a page follows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from philolog.functions import text as X

#: Fixed: by what collocates, keywords, clusters, n-grams, patterns and plots may be ordered.
COLLOCATE_KEYS = (
    "frequency", "left_frequency", "right_frequency", "range", "mi", "t_score", "log_dice", "dice", "mi2", "mi3", "minimum_sensitivity", "mu", "rrf", "drf", "z_score", "log_ratio", "log_likelihood", "chi_square", "term",
)
KEYWORD_KEYS = ("log_likelihood", "chi_square", "log_ratio", "frequency", "term")
CLUSTER_KEYS, RUN_KEYS = ("frequency", "range", "probability", "term"), ("frequency", "range", "term")
PLOT_KEYS = {"doc_id": "document_id", "filename": "filename", "tokens": "tokens", "frequency": "hits", "normalized_frequency": "per_million", "dispersion": "dispersion"}
OCCURRENCE_KEYS = ("L5", "L4", "L3", "L2", "L1", "CEN", "R1", "R2", "R3", "R4", "R5")


def _known(key: str, keys) -> str:
    if key not in keys:
        raise ValueError(f"unknown order {key}")
    return key


def _down(*names: str) -> list[Column]:
    return [F.col(n).desc() for n in names]


def _by_term(term: str = "term") -> list[Column]:
    return [X.casefold(F.col(term)), F.col(term)]


def collocates(key: str = "frequency") -> list[Column]:
    """Greatest value first, then frequency, then term."""
    if _known(key, COLLOCATE_KEYS) == "term":
        return [*_by_term(), *_down("frequency")]
    name = "document_range" if key == "range" else key
    return [*_down(*dict.fromkeys((name, "frequency"))), *_by_term()]


def keywords(key: str = "log_likelihood") -> list[Column]:
    """Strongest first whichever corpus a word is typical of."""
    if _known(key, KEYWORD_KEYS) == "term":
        return [X.casefold(F.col("term")), *_down("target_frequency", "reference_frequency"), F.col("term")]
    if key == "frequency":
        return [*_down("target_frequency", "reference_frequency"), *_by_term()]
    return [F.abs(key).desc(), *_down("target_frequency"), *_by_term()]


def runs(key: str = "frequency", term: str = "term") -> list[Column]:
    """N-grams (term) and patterns with an open place (pattern)."""
    order = {"frequency": _down("frequency", "document_range"), "range": _down("document_range", "frequency"), "term": []}[_known(key, RUN_KEYS)]
    return [*order, *_by_term(term), *([] if order else _down("frequency"))]


def clusters(key: str = "frequency") -> list[Column]:
    if _known(key, CLUSTER_KEYS) == "probability":
        return [*_down("transition_probability", "frequency"), *_by_term()]
    return runs(key)


def plots(key: str = "doc_id", invert: bool = False) -> list[Column]:
    """Rows of a plot; inverting keeps the order of ties."""
    name = PLOT_KEYS[_known(key, PLOT_KEYS)]
    value = X.casefold(F.col(name)) if name == "filename" else F.col(name)
    return [value.desc() if invert else value.asc(), F.col("document_id").desc() if invert and name == "document_id" else F.col("document_id").asc()]


def occurrences(keys: list[str]) -> list[Column]:
    """Up to three context keys (a missing neighbour counts as an empty word), then the pair and the place in it."""
    if len(keys) > 3:
        raise ValueError("more than 3 sort keys")
    return [*(F.coalesce(F.col(_known(k, OCCURRENCE_KEYS)), F.lit("")) for k in keys), F.col("pair_no"), F.col("occurrence_ordinal")]
