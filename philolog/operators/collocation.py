"""Collocates and dispersion plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from philolog.functions.measures import Contingency
from philolog.operators.concordance import phrase_hits
from philolog.plans.query import parse_simple


def nodes(tokens: DataFrame, query: str) -> DataFrame:
    """Hits within sentences."""
    return phrase_hits(tokens, parse_simple(query), scope="sentence")


def context_tokens(tokens: DataFrame, found: DataFrame, left: int, right: int) -> DataFrame:
    """Every token within the span of every node; one that lies near two nodes comes twice.

    A node asks for positions of its own sentence, so the range becomes an equality.
    """
    offsets = F.concat(F.when(F.lit(left) > 0, F.sequence(F.lit(-left), F.lit(-1))).otherwise(F.array().cast("array<int>")), F.when(F.lit(right) > 0, F.sequence(F.col("token_length"), F.col("token_length") + right - 1)).otherwise(F.array().cast("array<int>")))
    asked = found.withColumn("off", F.explode(offsets)).select("document_id", "sentence_no", (F.col("sentence_position") + F.col("off")).alias("sentence_position"), (F.col("off") < 0).alias("is_left"))
    return asked.join(tokens.select("document_id", "sentence_no", "sentence_position", "normalized", "surface", "pos"), ["document_id", "sentence_no", "sentence_position"])


def collocates(tokens: DataFrame, query: str, *, left: int = 5, right: int = 5, pos: str = "", min_frequency: int = 1, min_range: int = 1, punctuation: bool = False, within: DataFrame | None = None) -> DataFrame:
    """Words near the query's hits with frequencies by side, range, corpus frequency and all association measures.

    tokens are of one language. pos and punctuation limit the words near a hit, not the hit. within: the
    tokens of all documents that can hold a hit, where they are fewer; all tokens are then only counted.
    """
    if left < 0 or right < 0 or left + right == 0:
        raise ValueError("one span at least must be positive")

    def able(of: DataFrame) -> DataFrame:
        kept = of if punctuation else of.where(~F.col("is_punctuation"))
        return kept.where(F.col("pos") == pos) if pos else kept

    within = tokens if within is None else within
    near = context_tokens(able(within), nodes(within, query), left, right)
    per = near.groupBy("normalized", "document_id").agg(F.min("surface").alias("display"), F.count(F.lit(1)).alias("n"), F.sum(F.col("is_left").cast("long")).alias("l"), F.collect_set("pos").alias("pos"))
    observed = per.groupBy("normalized").agg(F.min("display").alias("display"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pos")))), ",").alias("pos"), F.sum("n").alias("frequency"), F.sum("l").alias("left_frequency"), F.count(F.lit(1)).alias("document_range"))
    opportunities = observed.agg(F.sum("frequency").alias("opportunities"))
    corpus = able(tokens).groupBy("normalized").agg(F.count(F.lit(1)).alias("corpus_frequency"))
    size = corpus.agg(F.sum("corpus_frequency").alias("size"))
    rows = observed.where((F.col("frequency") >= min_frequency) & (F.col("document_range") >= min_range)).join(corpus, "normalized")
    rows = rows.crossJoin(F.broadcast(opportunities)).crossJoin(F.broadcast(size))  # one row each
    joint = F.least("frequency", "opportunities", "corpus_frequency")
    table = Contingency.from_marginals(joint, F.col("opportunities"), F.col("corpus_frequency"), F.greatest(F.col("size"), F.col("opportunities") + F.col("corpus_frequency") - joint))
    return rows.select(F.col("normalized").alias("term"), "display", "pos", "frequency", "left_frequency", (F.col("frequency") - F.col("left_frequency")).alias("right_frequency"), "document_range", "corpus_frequency", *[c.alias(k) for k, c in table.measures().items()])


def plot_bins(tokens: DataFrame, query: str, bins: int = 50) -> DataFrame:
    """document_id, bin (from 0), hits: where in each document the query's hits lie."""
    found = nodes(tokens, query)
    span = F.col("document_length") - 1
    place = F.when(span == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("stream_position") - 1) * (bins - 1) / span)))
    return found.groupBy("document_id", place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("hits"))


def dispersion(plot: DataFrame, bins: int = 50) -> DataFrame:
    """document_id, hits, dispersion: 1 for hits spread evenly over the bins, 0 for those in one bin or a single hit.

    Empty bins each add 1 / bins to the distance from an even spread, so only filled ones are rows.
    """
    return _profiles(plot, bins).select("document_id", "hits", "dispersion")


def _profiles(cells: DataFrame, bins: int) -> DataFrame:
    """document_id, hits, dispersion, m: hits by bin; cells are read once."""
    per = cells.groupBy("document_id").agg(F.sum("hits").alias("hits"), F.collect_list(F.struct("bin", "hits")).alias("each"))
    apart = F.aggregate("each", F.lit(0.0), lambda acc, e: acc + F.abs(e["hits"] / F.col("hits") - 1 / bins)) + (bins - F.size("each")) / F.lit(float(bins))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / (2 * (1 - 1 / bins))))
    return per.select("document_id", "hits", F.when(F.col("hits") <= 1, F.lit(0.0)).otherwise(value).alias("dispersion"), F.map_from_entries("each").alias("m"))


def plot(tokens: DataFrame, query: str, overlay: str = "", bins: int = 50, zero_hits: bool = False) -> DataFrame:
    """Per document: tokens, hits, overlay_hits, frequency per million, dispersion, and both as arrays of `bins` counts."""
    documents = tokens.groupBy("document_id").agg(F.count(F.lit(1)).alias("tokens"))
    rows, parts = documents, [("hits", query), ("overlay_hits", overlay)]
    for name, text in parts:
        if not text:
            rows = rows.withColumn(name, F.lit(0).cast("long")).withColumn(f"{name}_cells", F.array_repeat(F.lit(0).cast("long"), bins)).withColumn(f"{name}_dispersion", F.lit(0.0))
            continue
        found = _profiles(plot_bins(tokens, text, bins), bins)
        dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b.cast("long")), F.lit(0).cast("long")))
        found = found.select("document_id", F.col("hits").alias(name), dense.alias(f"{name}_cells"), F.col("dispersion").alias(f"{name}_dispersion"))
        rows = rows.join(found, "document_id", "left").na.fill({name: 0, f"{name}_dispersion": 0.0}).withColumn(f"{name}_cells", F.coalesce(f"{name}_cells", F.array_repeat(F.lit(0).cast("long"), bins)))
    rows = rows.withColumn("per_million", F.col("hits") * 1e6 / F.col("tokens"))
    return rows if zero_hits else rows.where("hits > 0 or overlay_hits > 0")
