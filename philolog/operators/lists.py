"""Word lists, n-grams, open slots, clusters, keywords and word clouds."""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from philolog.functions import measures
from philolog.functions import text as X
from philolog.operators import index
from philolog.plans.query import split_terms

JOINER = "\x1f"
#: Parts over which runs are dealt, whatever the session's: so many that a part of some GB of texts is sorted in memory.
RUN_PARTS = 200
#: Fixed: canvas of a cloud and its margin; advance of radius and angle, turn of each term, flatness; width of a plain letter, height of a line; gaps beside and above; tries.
CLOUD_WIDTH, CLOUD_HEIGHT, MARGIN = 960, 540, 16
OUTWARD, TURN, OFFSET, FLAT, LETTER, LINE, GAP_X, GAP_Y, TRIES = 0.34, 0.48, 0.19, 0.56, 0.58, 1.12, 5, 4, 2600


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds rank over a total order."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def list_order(sort: str, term: str = "term", invert: bool = False) -> list[Column]:
    """Orders of lists: frequency, range, term, or end (words read backwards); inverted as a whole."""
    f, r, t = F.col("frequency"), F.col("document_range"), F.col(term)
    order = {"frequency": [(f, 1), (r, 1), (t, 0)], "range": [(r, 1), (f, 1), (t, 0)], "term": [(t, 0), (f, 1)], "end": [(F.reverse(F.lower(t)), 0), (f, 1), (t, 0)]}[sort]
    return [c.desc() if bool(down) != invert else c.asc() for c, down in order]


def word_list(tokens: DataFrame, *, language: str | None = None, pos: str = "", min_frequency: int = 1, min_range: int = 1, contains: str = "", punctuation: bool = False) -> DataFrame:
    """Static list: term, display, frequency, document_range, per_million; the base of per_million ignores pos."""
    own = tokens if language is None else tokens.where(F.col("language") == language)
    own = own if punctuation else own.where(~F.col("is_punctuation"))
    rows = index.word_totals(own.where(F.col("pos") == pos) if pos else own)
    size = (index.word_totals(own) if pos else rows).agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("size"))
    rows = rows.where((F.col("frequency") >= min_frequency) & (F.col("document_range") >= min_range))
    if contains:
        rows = rows.where(F.col("normalized").contains(contains.casefold()))
    return rows.crossJoin(F.broadcast(size)).select(F.col("normalized").alias("term"), "display", "frequency", "document_range", measures.ratio(F.col("frequency") * 1e6, F.col("size")).alias("per_million"))  # one row


def dynamic_list(tokens: DataFrame, *, kind: str = "type", case_sensitive: bool = False, stop: list[str] | None = None, allow: list[str] | None = None, pos: str = "", punctuation: bool = False, min_frequency: int = 1, min_range: int = 1) -> DataFrame:
    """List by type, type_pos or headword, with a stop or an allow list: term, frequency, document_range, per_million.

    The base of per_million obeys pos but not the lists. The display is the first surface in the corpus.
    tokens may be an index.term_table() for lists of folded types.
    """
    merged = "n" in tokens.columns
    if merged and (kind != "type" or case_sensitive):
        raise ValueError("merged words have no surfaces to list")
    if stop and allow:
        raise ValueError("a stop list and an allow list exclude each other")
    own = tokens if punctuation else tokens.where(~F.col("is_punctuation"))
    own = own.where(F.col("pos") == pos) if pos else own
    size = own.agg((F.coalesce(F.sum("n"), F.lit(0)) if merged else F.count(F.lit(1))).alias("size"))
    for words, keep in ((stop, False), (allow, True)):
        if words:
            listed = F.col("normalized").isin([w.casefold() for w in words])
            own = own.where(listed if keep else ~listed)
    if merged:
        rows = own.select(F.col("normalized").alias("term"), "document_id", "n", F.struct(F.struct("document_id", F.col("at").alias("stream_position")).alias("at"), F.col("first").alias("surface")).alias("first"))
        # dealt first, as merging the rows of a task again would only hold them in memory
        rows = rows.repartition("term", "document_id").groupBy("term", "document_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    else:
        rows = _by_key(own, kind, case_sensitive)
    rows = rows.groupBy("term").agg(F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("document_range"), F.min("first").alias("first"))
    rows = rows.where((F.col("frequency") >= min_frequency) & (F.col("document_range") >= min_range))
    return rows.crossJoin(F.broadcast(size)).select("term", F.col("first.surface").alias("display"), "frequency", "document_range", measures.ratio(F.col("frequency") * 1e6, F.col("size")).alias("per_million"))  # one row


def _by_key(own: DataFrame, kind: str, case_sensitive: bool) -> DataFrame:
    """Tokens merged by what a list shows and document: term, document_id, n, first."""
    word = F.col("surface") if case_sensitive else F.col("normalized")
    head = F.coalesce(F.nullif(F.col("lemma"), F.lit("")), F.col("surface"))
    key = {"type": word, "headword": head if case_sensitive else X.casefold(head), "type_pos": F.concat_ws("_", word, F.col("pos"))}[kind]
    first = F.struct("document_id", "stream_position")
    return own.withColumn("term", key).groupBy("term", "document_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(first.alias("at"), F.col("surface"))).alias("first"))


def ngrams(documents: DataFrame, n: int, *, language: str = "en", min_frequency: int = 2, min_range: int = 1, contains: str = "", punctuation: bool = False) -> DataFrame:
    """term (folded words), display (the first surfaces seen), frequency, document_range."""
    runs = index.windows(documents, n, language)
    # whether a run holds punctuation or a text is told by its folded words, so such runs needn't be counted first
    runs = runs if punctuation else runs.where(~F.col("has_punctuation"))
    runs = runs.where(F.array_join("words", " ").contains(contains.casefold())) if contains else runs
    # shuffled once, by term, with the surfaces only where they are not the words
    shown = F.when(F.col("surfaces") != F.col("words"), F.array_join("surfaces", " "))
    rows = runs.select(F.array_join("words", JOINER).alias("term"), "document_id", "position", shown.alias("display")).repartition(RUN_PARTS, "term")
    rows = rows.groupBy("term", "document_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("document_id", "position", "display")).alias("first"))
    rows = rows.groupBy("term").agg(F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("document_range"), F.min("first").alias("first"))
    rows = rows.where((F.col("frequency") >= min_frequency) & (F.col("document_range") >= min_range)).withColumn("term", F.replace("term", F.lit(JOINER), F.lit(" ")))
    return rows.select("term", F.coalesce("first.display", "term").alias("display"), "frequency", "document_range")


def open_slot_ngrams(documents: DataFrame, n: int, slot: int, *, language: str = "en", min_frequency: int = 2, min_range: int = 1, contains: str = "", punctuation: bool = False) -> DataFrame:
    """Patterns with one open place (from 1): frequency, document_range, variants (surfaces there), type_token_ratio, entropy."""
    runs = index.windows(documents, n, language)
    runs = runs if punctuation else runs.where(~F.col("has_punctuation"))
    words = F.transform("words", lambda w, i: F.when(i == slot - 1, F.lit("<*>")).otherwise(w))
    rows = runs.select(F.array_join(words, " ").alias("pattern"), F.element_at("surfaces", slot).alias("variant"), "document_id")
    # shuffled once, by pattern; the first row of a variant and of a document counts it. Sorts compare the
    # pattern's hash first, and its letters for equal hashes alone
    key = ["hash", "pattern"]
    per = rows.withColumn("hash", F.xxhash64("pattern")).repartition(RUN_PARTS, *key).groupBy(*key, "variant", "document_id").agg(F.count(F.lit(1)).alias("n"))
    of_variant, of_document = Window.partitionBy(*key, "variant"), Window.partitionBy(*key, "document_id").orderBy("variant")
    per = per.withColumn("all", F.sum("n").over(of_variant)).withColumn("v", F.row_number().over(of_variant.orderBy("document_id")) == 1).withColumn("d", F.row_number().over(of_document) == 1)
    # -sum p log2 p with p = n / f is log2 f - sum n log2 n / f
    variant = lambda x: F.when(F.col("v"), x)
    stats = per.groupBy(*key).agg(F.sum("n").alias("frequency"), F.count_if("d").alias("document_range"), F.count_if("v").alias("variants"), F.sum(variant(F.col("all") * F.log2("all"))).alias("s"))
    stats = stats.where((F.col("frequency") >= min_frequency) & (F.col("document_range") >= min_range))
    stats = stats.where(X.casefold(F.col("pattern")).contains(contains.casefold())) if contains else stats
    return stats.select("pattern", "frequency", "document_range", "variants", (F.col("variants") / F.col("frequency")).alias("type_token_ratio"), (F.log2("frequency") - F.col("s") / F.col("frequency")).alias("entropy"))


def clusters(documents: DataFrame, query: str, *, size: int = 3, side: str = "left", language: str = "en", min_frequency: int = 2, min_range: int = 1, punctuation: bool = False) -> DataFrame:
    """Runs that begin (left) or end (right) with the query: frequency, document_range, per_million of all tokens, transition_probability.

    The probability divides by how often the run's last size - 1 words end any run of that size.
    """
    terms = [t.casefold() for t in split_terms(query)]
    if not 1 <= len(terms) <= size:
        raise ValueError("the query must have from one to `size` tokens")
    runs = index.windows(documents, size, language)
    runs = runs if punctuation else runs.where(~F.col("has_punctuation"))
    edge = F.slice("words", 1 if side == "left" else size - len(terms) + 1, len(terms))
    first = F.struct("document_id", "position")
    own = runs.where(edge == F.array(*map(F.lit, terms)))
    rows = own.groupBy("words", "document_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(first.alias("at"), F.array_join("surfaces", " ").alias("display"))).alias("first"))
    rows = rows.groupBy("words").agg(F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("document_range"), F.min("first").alias("first"))
    rows = rows.where((F.col("frequency") >= min_frequency) & (F.col("document_range") >= min_range)).withColumn("suffix", F.slice("words", 2, size - 1))
    suffixes = runs.select(F.slice("words", 2, size - 1).alias("suffix")).join(rows.select("suffix").distinct(), "suffix", "left_semi").groupBy("suffix").agg(F.count(F.lit(1)).alias("all"))
    total = index.sentence_table(documents.where(F.col("lang") == language)).agg(F.sum(F.size("tokens")).alias("size"))
    return rows.join(suffixes, "suffix").crossJoin(F.broadcast(total)).select(F.array_join("words", " ").alias("term"), F.col("first.display").alias("display"), "frequency", "document_range", measures.ratio(F.col("frequency") * 1e6, F.col("size")).alias("per_million"), (F.col("frequency") / F.col("all")).alias("transition_probability"))  # one row


def keywords(target: DataFrame, reference: DataFrame, *, min_frequency: int = 1, min_range: int = 1, negatives: bool = False) -> DataFrame:
    """Words of two token tables with keyness measures; minimums hold if either corpus meets them."""
    sides = {}
    for name, tokens in (("target", target), ("reference", reference)):
        sides[name] = index.word_totals(tokens.where(~F.col("is_punctuation"))).groupBy("normalized").agg(F.sum("frequency").alias(f"{name}_frequency"), F.sum("document_range").alias(f"{name}_range"), F.min("display").alias(f"{name}_display"))
    sizes = [d.agg(F.coalesce(F.sum(f"{n}_frequency"), F.lit(0)).alias(f"{n}_size")) for n, d in sides.items()]
    rows = sides["target"].join(sides["reference"], "normalized", "full_outer").na.fill(0)
    rows = rows.where((F.greatest("target_frequency", "reference_frequency") >= min_frequency) & (F.greatest("target_range", "reference_range") >= min_range))
    rows = rows.crossJoin(F.broadcast(sizes[0])).crossJoin(F.broadcast(sizes[1]))  # one row each
    values = measures.keyness(*[F.col(c) for c in ("target_frequency", "target_size", "reference_frequency", "reference_size")])
    rows = rows.select(F.col("normalized").alias("term"), F.coalesce("target_display", "reference_display").alias("display"), "target_frequency", "reference_frequency", "target_range", "reference_range", *[c.alias(k) for k, c in values.items()])
    return rows if negatives else rows.where(F.col("log_ratio") >= 0)


def cloud_terms(rows: DataFrame, k: int, stop: list[str] | None = None) -> DataFrame:
    """The k most frequent words of a word list with font sizes from 18 to 72 on a logarithmic scale."""
    rows = rows.where(~F.col("term").isin([w.casefold() for w in stop])) if stop else rows
    top = rows.orderBy(*list_order("frequency")).limit(k)
    bounds = Window.partitionBy()
    low, high = F.min("frequency").over(bounds), F.max("frequency").over(bounds)
    size = F.when(high <= low, F.lit(40.0)).otherwise(F.round(18 + 54 * (F.log1p("frequency") - F.log1p(low)) / (F.log1p(high) - F.log1p(low)), 2))
    return top.select("term", "frequency", "document_range", size.alias("font_size"))


#: Fixed: colours of the themes of a cloud.
THEMES = {
    "ocean": ("#0f4c81", "#1261a0", "#1778b5", "#1597a5", "#2d9cdb", "#58b6d9"),
    "forest": ("#174c3c", "#236b4e", "#2f855a", "#479f76", "#68b984", "#8acb88"),
    "sunset": ("#713c67", "#9a3f62", "#c94c5c", "#e76f51", "#f49d5b", "#efbd68"),
}


def cloud_layout(terms: list[tuple[str, int, float]], palette: tuple[str, ...] = THEMES["ocean"]) -> list[dict]:
    """Places terms (at most some hundreds) outward on an ellipse, each at the first free place; a term without one is left out."""
    boxes, out = np.zeros((0, 4)), []
    step = np.arange(TRIES)
    for rank, (term, frequency, size) in enumerate(terms):
        letters = sum(1.0 if unicodedata.east_asian_width(c) in "WFA" else LETTER for c in term)
        across = min(max(size, letters * size), CLOUD_WIDTH - 2 * MARGIN) / 2 + GAP_X
        half = np.array([across, size * LINE / 2 + GAP_Y])
        # every spot of the term's spiral at once: those within the canvas that meet no box placed so far
        turn = TURN * step + OFFSET * rank
        spots = np.array([CLOUD_WIDTH, CLOUD_HEIGHT]) / 2 + OUTWARD * step[:, None] * np.stack((np.cos(turn), FLAT * np.sin(turn)), 1)
        low, high = spots - half, spots + half
        within = (low >= MARGIN).all(1) & (high <= np.array([CLOUD_WIDTH, CLOUD_HEIGHT]) - MARGIN).all(1)
        meets = ((low[:, None] < boxes[None, :, 2:]) & (boxes[None, :, :2] < high[:, None])).all(2).any(1)
        free = np.flatnonzero(within & ~meets)
        if len(free):
            x, y = spots[free[0]].tolist()
            boxes = np.vstack((boxes, np.concatenate((low[free[0]], high[free[0]]))))
            out.append({"term": term, "frequency": frequency, "font_size": size, "x": round(x, 2), "y": round(y, 2), "color": palette[rank % len(palette)]})
    return out
