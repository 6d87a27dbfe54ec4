"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; nothing is gathered on the driver but one checksum row.
A vertex with very many neighbours is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(*pairs: tuple[str, str]) -> Column:
    """One row for each pair of columns; written as an explosion, as a union would plan the table once for each of its sides."""
    return F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")


def _minimum_join(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m: the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(_pairs(("u", "v"), ("v", "u"))).select("e.*")
    return _minimum_join(both).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    return _minimum_join(edges).select(_pairs(("v", "m"), ("u", "m"))).select("e.*").where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: long); root is the least node of the component.

    Loops and null ends are ignored; an empty table gives an empty table. Every round is cut with
    checkpoint() and ends by comparing a count and a checksum with the round before.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        edges = _small_star(_large_star(edges)).checkpoint()
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return edges.select(_pairs(("u", "v"), ("v", "v"))).select(F.col("e.u").alias("node"), F.col("e.v").alias("root")).distinct()
