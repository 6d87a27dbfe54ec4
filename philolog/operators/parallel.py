"""Search in aligned pairs, and an audit of them.

A pair table has pair_no (its order), a_text and b_text (two sides), alignment_unit, filename and
confidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from philolog.functions import text as X
from philolog.operators import index
from philolog.sources.sinks import replace


@dataclass
class PairQuery:
    """q is sought on `side`; *_has and *_lacks hold for a side's whole text."""

    q: str = ""
    side: str = "a"
    a_has: str = ""
    b_has: str = ""
    a_lacks: str = ""
    b_lacks: str = ""
    filename_has: str = ""
    alignment_unit: str = ""
    min_confidence: float = 0.0
    whole_words: bool = False
    token_borders: bool = False
    case_sensitive: bool = False
    every: int = 1
    context: int = 5

    def anchor(self) -> tuple[str, str]:
        """The side and the term whose occurrences become rows."""
        if self.q:
            return self.side, self.q
        for side in (self.side, "a", "b"):
            if term := getattr(self, f"{side}_has"):
                return side, term
        return self.side, ""

    def condition(self) -> Column:
        def holds(side: str, term: str) -> Column:
            return X.contains_term(F.col(f"{side}_text"), term, case_sensitive=self.case_sensitive, whole_words=self.whole_words)

        out = F.lit(True)
        for side, term, wanted in ((self.side, self.q, True), ("a", self.a_has, True), ("b", self.b_has, True), ("a", self.a_lacks, False), ("b", self.b_lacks, False)):
            if term:
                out = out & (holds(side, term) if wanted else ~holds(side, term))
        if self.filename_has:
            out = out & F.lower("filename").contains(self.filename_has.lower())
        if self.alignment_unit:
            out = out & (F.col("alignment_unit") == self.alignment_unit)
        if self.min_confidence:
            out = out & (F.col("confidence") >= self.min_confidence)
        return out


def matching_pairs(pairs: DataFrame, query: PairQuery) -> DataFrame:
    return pairs.where(query.condition())


def occurrences(pairs: DataFrame, query: PairQuery) -> DataFrame:
    """One row for each occurrence of the anchor term: the pair with occurrence_ordinal, start, end; without a term, one row without a span."""
    side, term = query.anchor()
    found = matching_pairs(pairs, query)
    if not term:
        none = F.lit(None).cast("int")
        return found.select("*", F.lit(1).alias("occurrence_ordinal"), none.alias("start"), none.alias("end"))
    spans = X.spans_of(F.col(f"{side}_text"), term, case_sensitive=query.case_sensitive, whole_words=query.whole_words, token_borders=query.token_borders)
    rows = found.select("*", F.posexplode(spans).alias("_i", "_s")).select(*pairs.columns, (F.col("_i") + 1).alias("occurrence_ordinal"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))
    return every_nth(rows, query.every, pairs) if query.every > 1 else rows


def every_nth(rows: DataFrame, k: int, pairs: DataFrame) -> DataFrame:
    """Every k-th row in the order of pair_no and ordinal, the first included.

    Ranks are a prefix sum over ranges of the pairs' numbers, so that no task orders all rows.
    """
    rows = rows.withColumn("_part", index.part_of(pairs, "pair_no"))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("pair_no", "occurrence_ordinal"))
    rows = rows.withColumn("_rank", rank).join(F.broadcast(sizes), "_part")  # a row per part
    return rows.where((F.col("_before") + F.col("_rank") - 1) % k == 0).drop("_part", "_rank", "_before")


def with_context(rows: DataFrame, query: PairQuery) -> DataFrame:
    """Adds left, keyword, right (up to `context` tokens, … where more was cut) and sort keys L5..L1, CEN, R1..R5."""
    side, _ = query.anchor()
    text, n = F.col(f"{side}_text"), query.context
    before, after = F.left(text, F.col("start")), F.substring(text, F.col("end") + 1, F.length(text))
    rows = rows.withColumn("_l", X.tokens(before)).withColumn("_r", X.tokens(after)).withColumn("keyword", F.substring(text, F.col("start") + 1, F.col("end") - F.col("start")))
    left = F.array_join(F.slice("_l", F.greatest(F.lit(1), F.size("_l") - n + 1), F.lit(max(n, 1))), " ") if n else F.lit("")
    right = F.array_join(F.slice("_r", 1, n), " ") if n else F.lit("")
    rows = rows.withColumn("left", F.concat(F.when(F.size("_l") > n, "…").otherwise(""), left)).withColumn("right", F.concat(right, F.when(F.size("_r") > n, "…").otherwise("")))
    keys = [X.casefold(F.get("_l", F.size("_l") - k)).alias(f"L{k}") for k in range(5, 0, -1)] + [X.casefold(F.col("keyword")).alias("CEN")] + [X.casefold(F.get("_r", F.lit(k - 1))).alias(f"R{k}") for k in range(1, 6)]
    return rows.select("*", *keys).drop("_l", "_r")


def _first(pairs: DataFrame, most: int | None) -> DataFrame:
    return pairs if most is None else pairs.orderBy("pair_no").limit(most)


def infer_highlights(pairs: DataFrame, query: PairQuery, *, max_matches: int | None = None, max_background: int | None = None) -> DataFrame:
    """Likely equivalents of q on the other side: key, surface, score.

    Words are scored by the log odds of being in a matching pair, times log1p of the matching pairs
    with the word. All pairs count, or the first ones by pair_no if bounds are given.
    """
    #: Fixed: least matches, coverage and score; share of the best score; groups and surfaces of a group.
    least, coverage, floor, share, groups, surfaces = 5, 0.20, 3.0, 0.55, 2, 4
    other = "b" if query.side == "a" else "a"
    matched = _first(matching_pairs(pairs, query), max_matches).select("pair_no", f"{other}_text", F.lit(1).alias("hit"))
    ground = pairs.where(F.col("alignment_unit") == query.alignment_unit) if query.alignment_unit else pairs
    ground = _first(ground, max_background).select("pair_no", f"{other}_text", F.lit(0).alias("hit"))
    both = matched.union(ground).groupBy("pair_no").agg(F.max("hit").alias("hit"), F.first(f"{other}_text").alias("text"))
    totals = both.agg(F.sum("hit").alias("m"), F.sum(1 - F.col("hit")).alias("g"))
    terms = both.select("pair_no", "hit", F.explode(X.candidate_terms(F.col("text"), "en")).alias("t")).select("pair_no", "hit", "t.*")
    keys = terms.select("pair_no", "hit", "key").distinct().groupBy("key").agg(F.sum("hit").alias("mk"), F.sum(1 - F.col("hit")).alias("gk"))
    keys = keys.crossJoin(F.broadcast(totals)).where((F.col("m") >= least) & (F.col("g") > 0) & (F.col("mk") >= coverage * F.col("m")))  # one row
    odds = ((F.col("mk") + 0.5) / (F.col("m") - F.col("mk") + 0.5)) / ((F.col("gk") + 0.5) / (F.col("g") - F.col("gk") + 0.5))
    keys = keys.withColumn("score", F.ln(odds) * F.log1p("mk")).where(F.col("score") >= floor)
    everything = Window.partitionBy()
    keys = keys.withColumn("best", F.max("score").over(everything)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("key")))).where((F.col("score") >= share * F.col("best")) & (F.col("rank") <= groups))
    forms = terms.where("hit = 1").join(F.broadcast(keys.select("key", "score")), "key").groupBy("key", "score", "surface").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), F.desc(F.length("surface")), "surface")
    return forms.withColumn("place", F.row_number().over(order)).where(F.col("place") <= surfaces).select("key", "surface", "score", "place")


#: Columns of a stored pair.
PAIR_SCHEMA = "pair_no long, pair_id string, a_text string, b_text string, alignment_unit string, method string, filename string, confidence double"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from JSON lines; a line that isn't a pair fails the read."""
    return spark.read.schema(PAIR_SCHEMA).option("mode", "FAILFAST").json(path)


def write_report(audited: DataFrame, folder: str) -> None:
    """summary and anomalies of an audit as JSON lines, each put in place in one step after both were written."""
    parts = {"anomalies": first_anomalies(audited), "summary": audit_summary(audited)}
    for name, rows in parts.items():
        rows.coalesce(1).write.mode("overwrite").json(f"{folder}.new/{name}")  # 1,000 rows at most
    replace(audited.sparkSession, f"{folder}.new", folder)


#: Fixed: defaults of an audit.
LOW_CONFIDENCE, MIN_RATIO, MAX_RATIO, MAX_ANOMALIES = 0.60, 0.12, 1.80, 1000


def audit(pairs: DataFrame, low: float = LOW_CONFIDENCE, least: float = MIN_RATIO, most: float = MAX_RATIO) -> DataFrame:
    """pair_no, reasons, length_ratio for every pair.

    A pair equal to an earlier one is a duplicate; one whose target differs from the first target of
    its source is a variant. First ones are found by grouped minimums, so a frequent pair is not sorted.
    """
    rows = audit_rows(pairs)
    first = first_pairs(rows)
    rows = rows.join(first, ["a", "b"], "left").join(first_targets(first), "a", "left")
    return flagged(rows, low, least, most)


def audit_rows(pairs: DataFrame) -> DataFrame:
    """Pairs with a and b: their sides as an audit compares them."""
    return pairs.select("pair_no", "a_text", "b_text", "confidence", X.audit_form(F.coalesce("a_text", F.lit(""))).alias("a"), X.audit_form(F.coalesce("b_text", F.lit(""))).alias("b"))


def first_pairs(rows: DataFrame) -> DataFrame:
    """a, b, first_pair: the first number of each pair of sides that are both there."""
    return rows.where("a != '' and b != ''").groupBy("a", "b").agg(F.min("pair_no").alias("first_pair"))


def first_targets(first: DataFrame) -> DataFrame:
    """a, first_target."""
    return first.groupBy("a").agg(F.min_by("b", "first_pair").alias("first_target"))


def flagged(rows: DataFrame, low: float = LOW_CONFIDENCE, least: float = MIN_RATIO, most: float = MAX_RATIO) -> DataFrame:
    """pair_no, confidence, reasons, length_ratio of audit_rows() with first_pair and first_target."""
    a_units, b_units = X.symbol_units(F.coalesce("a_text", F.lit(""))), X.word_units(F.coalesce("b_text", F.lit("")))
    rows = rows.withColumn("length_ratio", F.when((a_units > 0) & (b_units > 0), F.round(b_units / F.when(a_units > 0, a_units), 4)))
    empty, bad = (F.col("a") == "") | (F.col("b") == ""), (F.col("confidence") < 0) | (F.col("confidence") > 1)
    flags = {
        "empty_side": empty,
        "duplicate_pair": ~empty & (F.col("first_pair") < F.col("pair_no")),
        "source_translation_variant": ~empty & (F.col("b") != F.col("first_target")),
        "invalid_confidence": bad,
        "low_confidence": ~bad & (F.col("confidence") < low),
        "length_ratio_outlier": (F.col("length_ratio") < least) | (F.col("length_ratio") > most),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return rows.select("pair_no", "confidence", reasons.alias("reasons"), "length_ratio")


def first_anomalies(audited: DataFrame, most: int = MAX_ANOMALIES) -> DataFrame:
    return audited.where(F.size("reasons") > 0).orderBy("pair_no").limit(most)


def audit_summary(audited: DataFrame, most: int = MAX_ANOMALIES) -> DataFrame:
    def having(reason: str) -> Column:
        return F.coalesce(F.sum(F.array_contains("reasons", reason).cast("long")), F.lit(0))

    flagged = F.coalesce(F.sum((F.size("reasons") > 0).cast("long")), F.lit(0))
    good = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    return audited.agg(
        F.count(F.lit(1)).alias("total_pairs"), having("empty_side").alias("empty_side_pairs"), having("duplicate_pair").alias("duplicate_pairs"), having("source_translation_variant").alias("translation_variants"),
        having("invalid_confidence").alias("invalid_confidence_pairs"), having("low_confidence").alias("low_confidence_pairs"), having("length_ratio_outlier").alias("length_ratio_outliers"), flagged.alias("anomalous_pairs"),
        F.least(flagged, F.lit(most)).alias("written_anomalies"), F.greatest(flagged - most, F.lit(0)).alias("suppressed_anomalies"), F.round(F.avg(good), 6).alias("mean_confidence"),
    )
