"""Texts marked up loosely by paragraphs and sentences, with tagged words, and the alignment of two of them.

A mark <p ...> or <s ...> opens a unit, which lasts until the next one of its kind; closing marks may
be missing. Words carry their tags (word/tag in Chinese, word_TAG in English), may stand together in
one run, and may lack tags. Everything is found by built-in functions within a text's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from philolog.functions import text as X

#: Fixed: a tag of a word, tags that have lost their word, notes in brackets, marks of an alignment, its arrows.
TAGGED = {"zh": r"([^/]+?)/([A-Za-z][A-Za-z0-9_-]*)(?=[^A-Za-z0-9_-]|$)", "en": r"^(.+)_([^_\s]+)$"}
ORPHAN, NOTE, LEADING, ARROWS = r"(?<!\S)/[A-Za-z][A-Za-z0-9_-]*", r"<?\[\s*[A-Z]{2,}[A-Z0-9-]*(?:\s+\d+(?:-\d+)?)?\s*\]>?", r"^(?:--?>|<--?)", ("-->", "->")
#: Fixed: signs before or after which English has no blank.
CLOSING, OPENING = ",.!?;:%)]}，。！？；：％）】》、", "([{（【《"
_NUMBER = r"(?i)\bn\s*=\s*(?:[\"'](\d+)[\"']|(\d+))"
_SIGN, _TOKENS = r"[\p{P}\p{S}]", "array<struct<word:string,pos:string>>"


def elements(text: Column, mark: str) -> Column:
    """array<struct<number:int,body:string>> of the units that a mark opens."""
    opening = rf"(?i)<{mark}\b[^>]*>"
    bodies = F.split(text, opening, -1)

    def number(found: Column) -> Column:
        digits = F.coalesce(F.nullif(F.regexp_extract(found, _NUMBER, 1), F.lit("")), F.nullif(F.regexp_extract(found, _NUMBER, 2), F.lit("")))
        return F.try_to_number(digits, F.lit("9" * 18)).cast("long")

    return F.transform(F.regexp_extract_all(text, F.lit(opening), F.lit(0)), lambda m, i: F.named_struct(F.lit("number"), number(m), F.lit("body"), F.get(bodies, i + 1)))


def _token(word: Column, pos: Column | str) -> Column:
    return F.named_struct(F.lit("word"), word, F.lit("pos"), F.lit(pos) if isinstance(pos, str) else pos)


def _signs(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: _token(c, "PUNCT"))


def _edged(text: Column, pos: Column | str) -> Column:
    """Tokens of a piece of text: signs at its edges one by one, and what is between them."""
    before = F.regexp_extract(text, rf"^({_SIGN}*)", 1)
    rest = F.substring(text, F.length(before) + 1, F.length(text))
    after = F.regexp_extract(rest, rf"({_SIGN}*)$", 1)
    core = F.substring(rest, F.lit(1), F.length(rest) - F.length(after))
    return F.concat(_signs(before), F.when(core != "", F.array(_token(core, pos))).otherwise(F.array().cast(_TOKENS)), _signs(after))


def _untagged(word: Column) -> Column:
    alone = _token(word, F.when(word.rlike(rf"^{_SIGN}+$"), "PUNCT").otherwise("UNK"))
    return F.when(word.isin(*ARROWS), F.array().cast(_TOKENS)).otherwise(F.array(alone))


def _english(word: Column) -> Column:
    bare = F.regexp_replace(F.regexp_extract(word, TAGGED["en"], 1), LEADING, "")
    one = F.when(bare != "", F.array(_token(bare, F.regexp_extract(word, TAGGED["en"], 2)))).otherwise(F.array().cast(_TOKENS))
    return F.when(word.rlike(TAGGED["en"]), one).otherwise(_untagged(word))


def _chinese(word: Column) -> Column:
    """Several tagged words may stand in one run, with signs and untagged text between them."""
    found, between = F.regexp_extract_all(word, F.lit(TAGGED["zh"]), F.lit(0)), F.split(word, TAGGED["zh"], -1)
    none = F.array().cast(_TOKENS)

    def gap(text: Column) -> Column:
        return F.when((text == "") | text.rlike(rf"^(?:{ORPHAN})$"), none).otherwise(_edged(text, "UNK"))

    def tagged(item: Column) -> Column:
        bare = F.regexp_replace(F.regexp_extract(item, r"^(.+)/([A-Za-z][A-Za-z0-9_-]*)$", 1), LEADING, "")
        return F.when(bare == "", none).otherwise(_edged(bare, F.regexp_extract(item, r"^(.+)/([A-Za-z][A-Za-z0-9_-]*)$", 2)))

    each = F.flatten(F.transform(found, lambda m, i: F.concat(gap(F.get(between, i)), tagged(m))))
    return F.when(F.size(found) > 0, F.concat(each, gap(F.element_at(between, -1)))).otherwise(_untagged(word))


def tokens(body: Column, language: Column) -> Column:
    """array<struct<word,pos>> of a unit's body: untagged words have the tag UNK, untagged signs PUNCT; other marks and notes are left out."""
    clean = F.regexp_replace(F.regexp_replace(body, NOTE, " "), "<[^>]*>", " ")
    clean = F.when(language == "zh", F.regexp_replace(clean, ORPHAN, " ")).otherwise(clean)
    words = F.filter(F.split(X.compact(clean), " "), lambda w: w != "")
    return F.when(language == "zh", F.flatten(F.transform(words, _chinese))).otherwise(F.flatten(F.transform(words, _english)))


def _pieces(found: Column, language: Column) -> Column:
    """Words, in English with the blank that stands before them."""

    def spaced(token: Column, i: Column) -> Column:
        before = F.right(F.get(found, i - 1)["word"], F.lit(1))
        blank = (language == "en") & (i > 0) & ~F.left(token["word"], F.lit(1)).isin(*CLOSING) & ~F.coalesce(before.isin(*OPENING), F.lit(False))
        return F.concat(F.when(blank, " ").otherwise(""), token["word"])

    return F.transform(found, spaced)


def structured(files: DataFrame) -> DataFrame:
    """Sentences of files (source_id, language, text): source_id, language, title, paragraph_no, paragraph_number, sentence_no, number, alignable, sentence, tokens (word, pos, start, end).

    Paragraphs without a number and without sentences are passed over. A paragraph without sentences is
    one, which no alignment of sentences takes. The title is what <head> holds. Null texts give no rows.
    """
    body, language = F.coalesce("text", F.lit("")), F.col("language")
    head = tokens(F.regexp_extract(body, r"(?is)<head\b[^>]*>(.*?)<\s*/\s*head\s*>", 1), language)
    parts = F.filter(F.transform(elements(body, "p"), lambda p: F.named_struct(F.lit("number"), p["number"], F.lit("body"), p["body"], F.lit("s"), elements(p["body"], "s"))), lambda p: p["number"].isNotNull() | (F.size(p["s"]) > 0))
    rows = files.select("source_id", "language", F.array_join(_pieces(head, language), "").alias("title"), F.posexplode(parts).alias("i", "p"))
    whole = F.array(F.struct(F.lit(None).cast("long").alias("number"), F.col("p.body").alias("body")))
    rows = rows.select("source_id", "language", "title", (F.col("i") + 1).alias("paragraph_no"), F.col("p.number").alias("paragraph_number"), (F.size("p.s") > 0).alias("alignable"), F.posexplode(F.when(F.size("p.s") > 0, F.col("p.s")).otherwise(whole)).alias("j", "s"))
    rows = rows.withColumn("t", tokens(F.col("s.body"), language)).where(F.col("alignable") | (F.size("t") > 0))
    # what is exploded is worked out once for each row
    rows = rows.withColumn("x", F.explode(F.array(F.struct(F.col("t").alias("t"), _pieces(F.col("t"), language).alias("w"))))).drop("t")
    lengths = F.transform("x.w", lambda w: F.length(w).cast("long"))
    rows = rows.withColumn("at", F.when(F.size("x.w") > 0, X.running(lengths)).otherwise(F.array().cast("array<long>")))
    placed = F.transform(F.col("x.t"), lambda t, i: F.struct(t["word"].alias("word"), t["pos"].alias("pos"), (F.get("at", i) + F.length(F.get("x.w", i)) - F.length(t["word"])).alias("start"), (F.get("at", i) + F.length(F.get("x.w", i))).alias("end")))
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("paragraph_no", "j"))
    return rows.select("source_id", "language", "title", "paragraph_no", "paragraph_number", number.alias("sentence_no"), F.col("s.number").alias("number"), "alignable", F.array_join("x.w", "").alias("sentence"), placed.alias("tokens"))


def paragraphs(sentences: DataFrame) -> DataFrame:
    """source_id, language, unit_no, number, text: the paragraphs of structured() rows."""
    by = ["source_id", "language", "paragraph_no"]
    grouped = sentences.groupBy(*by).agg(F.min("paragraph_number").alias("number"), F.transform(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))), lambda s: s["sentence"]).alias("s"))
    return grouped.select("source_id", "language", F.col("paragraph_no").alias("unit_no"), "number", F.when(F.col("language") == "zh", F.array_join("s", "")).otherwise(F.array_join("s", " ")).alias("text"))


def aligned(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, a_no, b_no, pair_no, a_text, b_text, method of pairs (pair_id, a_source, b_source) of units (source_id, unit_no, number, text).

    Two sides with the same numbers in the same order are joined by their order; its method is
    provided_structure_id if the numbers are all there and distinct, else provided_structure_order.
    Otherwise units are joined by number and by which of that number they are.
    """
    sides = []
    for side in ("a", "b"):
        own = pairs.select("pair_id", F.col(f"{side}_source").alias("source_id")).join(units, "source_id")
        nth = F.row_number().over(Window.partitionBy("pair_id", "number").orderBy("unit_no"))
        place = F.row_number().over(Window.partitionBy("pair_id").orderBy("unit_no"))
        sides.append(own.select("pair_id", F.col("unit_no").alias(f"{side}_no"), F.col("text").alias(f"{side}_text"), "number", nth.alias("nth"), place.alias("place")))
    shape = [s.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("place", "number")).alias("mark"), F.count_distinct("number").alias("numbers")) for s in sides]
    both = shape[0].join(shape[1].select("pair_id", F.col("n").alias("n_b"), F.col("mark").alias("mark_b")), "pair_id")
    both = both.select("pair_id", ((F.col("n") == F.col("n_b")) & (F.col("mark") == F.col("mark_b"))).alias("same"), (F.col("numbers") == F.col("n")).alias("distinct"))
    method = F.when(F.col("same") & ~F.col("distinct"), "provided_structure_order").otherwise("provided_structure_id")
    left = sides[0].join(both, "pair_id").withColumn("method", method)
    key = lambda: F.when(F.col("same"), F.struct(F.lit(-1).cast("long").alias("n"), F.col("place").alias("k"))).when(F.col("number").isNotNull(), F.struct(F.col("number").alias("n"), F.col("nth").alias("k")))
    left = left.withColumn("key", key()).where("key is not null").select("pair_id", "key", "a_no", "a_text", "method")
    right = sides[1].join(both, "pair_id").withColumn("key", key()).where("key is not null").select("pair_id", "key", "b_no", "b_text")
    met = left.join(right, ["pair_id", "key"])
    return met.select("pair_id", F.row_number().over(Window.partitionBy("pair_id").orderBy("a_no")).alias("pair_no"), "a_no", "b_no", "a_text", "b_text", "method")
