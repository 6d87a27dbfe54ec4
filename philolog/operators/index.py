"""The token table and what is aggregated from it once.

One row per token with three positions: in the corpus, in its document's stream and in its sentence.
Everything but the corpus position is worked out within a document's row, so building the table
shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from philolog.functions import cutting
from philolog.functions import text as X
from philolog.functions.segment import Lexicon
from philolog.sources.sinks import INDEX_VERSION

#: Ranges of numbers whose rows one window task orders.
PARTS = 256


def _cut(sentences: str, lexicon: Lexicon | None) -> Column:
    """Tokens of each sentence; those of Chinese ones by a lexicon, if there is one."""
    plain = F.transform(sentences, X.tokens)
    return plain if lexicon is None else F.coalesce(lexicon.tokens_of_each(F.when(F.col("language") == "zh", F.col(sentences))), plain)


def cut_rows(documents: DataFrame, kind: str, names: list[str], id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang") -> DataFrame:
    """Rows of a kind of cutting.ROWS with these columns: texts are cut once for each document, in Arrow."""
    own = documents.select(F.col(id_col).alias("document_id"), F.col(language_col).cast("string").alias("language"), F.col(text_col).alias("text"))
    types = dict(c.split(" ") for c in cutting.ROWS[kind][1].format(id=own.schema["document_id"].dataType.simpleString()).split(", "))
    return own.mapInArrow(cutting.cutter(kind, names), ", ".join(f"{n} {types[n]}" for n in names))


def sentence_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang", lexicon: Lexicon | None = None) -> DataFrame:
    """document_id, language, sentence_no (from 1), sentence, tokens (surfaces), tokens_before, document_length, stream_start."""
    if lexicon is None:
        return cut_rows(documents, "sentence", ["document_id", "language", "sentence_no", "sentence", "tokens", "tokens_before", "document_length", "stream_start"], id_col, text_col, language_col)
    base = documents.select(F.col(id_col).alias("document_id"), F.col(language_col).alias("language"), X.sentences(F.coalesce(F.col(text_col), F.lit("")), F.col(language_col)).alias("s"))
    base = base.withColumn("t", _cut("s", lexicon))
    base = base.withColumn("n", F.transform("t", lambda x: F.size(x).cast("long")))
    base = base.withColumn("z", F.arrays_zip(F.col("s").alias("sentence"), F.col("t").alias("tokens"), F.when(F.size("n") > 0, X.running(F.col("n"))).otherwise(F.array().cast("array<long>")).alias("before"), F.when(F.size("n") > 0, X.running(F.transform("s", lambda x: (F.length(x) + 1).cast("long")))).otherwise(F.array().cast("array<long>")).alias("start")))
    length = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    # the outer form, as from the inner one the optimizer infers a filter that cuts every text once more
    base = base.select("document_id", "language", length.alias("document_length"), F.posexplode_outer("z").alias("i", "z")).where("i is not null")
    return base.select("document_id", "language", (F.col("i") + 1).cast("long").alias("sentence_no"), "z.sentence", "z.tokens", F.col("z.before").alias("tokens_before"), "document_length", F.col("z.start").alias("stream_start"))


def token_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang", *, offsets: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """Tokens: document_id, language, sentence_no, sentence_position, stream_position, surface, normalized,
    lemma, pos, is_punctuation, sentence_length, document_length; with offsets also document_start and
    document_end, in code points of the stream (sentences joined with line feeds). A lexicon cuts
    Chinese text; it gives no offsets."""
    if offsets and lexicon:
        raise ValueError("words cut by a lexicon have no offsets")
    if not offsets and lexicon is None:
        names = ["document_id", "language", "sentence_no", "sentence_position", "stream_position", "surface", "normalized", "is_punctuation", "sentence_length", "document_length"]
        blank = F.lit("")
        rows = cut_rows(documents, "token", names, id_col, text_col, language_col)
        return rows.select(*names[:7], blank.alias("lemma"), blank.alias("pos"), *names[7:])
    rows = sentence_table(documents, id_col, text_col, language_col, lexicon)
    keep = ["document_id", "language", "sentence_no", "tokens_before", "document_length"]
    if offsets:
        gaps = F.slice(X.token_gaps(F.col("sentence")), F.lit(1), F.size("tokens"))
        rows = rows.withColumn("gap", F.transform(gaps, F.length)).withColumn("long", F.zip_with("gap", "tokens", lambda g, t: (g + F.length(t)).cast("long")))
        rows = rows.withColumn("at", F.when(F.size("tokens") > 0, X.running(F.col("long"))).otherwise(F.array().cast("array<long>")))
        rows = rows.withColumn("z", F.arrays_zip(F.col("tokens").alias("t"), "gap", "at"))
        rows = rows.select(*keep, "stream_start", F.size("tokens").cast("long").alias("sentence_length"), F.posexplode_outer("z").alias("i", "z")).where("i is not null")
        rows = rows.withColumn("surface", F.col("z.t")).withColumn("document_start", F.col("stream_start") + F.col("z.at") + F.col("z.gap"))
        rows = rows.withColumn("document_end", F.col("document_start") + F.length("surface"))
    else:
        rows = rows.select(*keep, F.size("tokens").cast("long").alias("sentence_length"), F.posexplode_outer("tokens").alias("i", "surface")).where("i is not null")
    position = (F.col("i") + 1).cast("long")
    return rows.select(
        "document_id", "language", "sentence_no", position.alias("sentence_position"), (F.col("tokens_before") + position).alias("stream_position"), "surface",
        X.casefold(F.col("surface")).alias("normalized"), F.lit("").alias("lemma"), F.lit("").alias("pos"), X.is_punctuation(F.col("surface")).alias("is_punctuation"), "sentence_length", "document_length",
        *(["document_start", "document_end"] if offsets else []),
    )


def term_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang") -> DataFrame:
    """The token table merged by document and word as texts are cut: n tokens, display the least surface, first the first surface, at its position."""
    names = ["document_id", "language", "normalized", "n", "display", "first", "at", "is_punctuation"]
    return cut_rows(documents, "term", names, id_col, text_col, language_col).withColumns({"lemma": F.lit(""), "pos": F.lit("")})


def document_streams(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang") -> DataFrame:
    text = F.array_join(X.sentences(F.coalesce(F.col(text_col), F.lit("")), F.col(language_col)), "\n")
    return documents.select(F.col(id_col).alias("document_id"), F.col(language_col).alias("language"), text.alias("text"))


def word_arrays(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang", *, offsets: bool = False, places: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """A row per document: document_id, language, d: surfaces, words (folded), before (tokens before each sentence);
    with offsets also stream, starts and ends (in code points of the stream), with places also paragraphs (tokens before each)."""
    if lexicon and (offsets or places):
        raise ValueError("words cut by a lexicon have no offsets and no paragraphs")
    if not offsets and not places and lexicon is None:
        names = ["surfaces", "words", "before"]
        return cut_rows(documents, "document", ["document_id", "language", *names], id_col, text_col, language_col).select("document_id", "language", F.struct(*names).alias("d"))
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.array().cast("array<long>")
    counts = F.transform(X.paragraphs(text), lambda x: F.regexp_count(X.compact(x), F.lit(X.TOKEN)).cast("long"))
    rows = documents.select(F.col(id_col).alias("document_id"), F.col(language_col).alias("language"), X.sentences(text, F.col(language_col)).alias("s"), *([counts.alias("p")] if places else []))
    if places:
        rows = rows.withColumn("paragraphs", F.when(F.size("p") > 0, X.running(F.col("p"))).otherwise(none))
    if offsets:
        rows = rows.withColumn("stream", F.array_join("s", "\n")).withColumn("surfaces", X.tokens(F.col("stream")))
        rows = rows.withColumn("n", F.transform("s", lambda x: F.regexp_count(x, F.lit(X.TOKEN)).cast("long")))
        rows = rows.withColumn("gaps", F.transform(F.slice(X.token_gaps(F.col("stream")), F.lit(1), F.size("surfaces")), F.length))
        rows = rows.withColumn("at", F.when(F.size("gaps") > 0, X.running(F.zip_with("gaps", "surfaces", lambda g, t: (g + F.length(t)).cast("long")))).otherwise(none))
        rows = rows.withColumn("starts", F.zip_with("at", "gaps", lambda x, g: x + g)).withColumn("ends", F.zip_with("starts", "surfaces", lambda x, t: x + F.length(t)))
    else:
        rows = rows.withColumn("t", _cut("s", lexicon)).withColumn("surfaces", F.flatten("t")).withColumn("n", F.transform("t", lambda x: F.size(x).cast("long")))
    rows = rows.withColumn("words", F.transform("surfaces", X.casefold)).withColumn("before", F.when(F.size("n") > 0, X.running(F.col("n"))).otherwise(none))
    names = ["surfaces", "words", "before", *(["stream", "starts", "ends"] if offsets else []), *(["paragraphs"] if places else [])]
    # what is exploded is worked out once for each row, however often an expression above names it
    return rows.select("document_id", "language", F.explode(F.array(F.struct(*names))).alias("d"))


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang") -> DataFrame:
    """document_id, n: tokens of each document that has any."""
    cut = F.transform(X.sentences(F.coalesce(F.col(text_col), F.lit("")), F.col(language_col)), lambda x: F.regexp_count(x, F.lit(X.TOKEN)).cast("long"))
    return documents.select(F.col(id_col).alias("document_id"), F.aggregate(cut, F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).where("n > 0")


def part_of(rows: DataFrame, column: str, parts: int = PARTS) -> Column:
    """Which of about `parts` ranges with like numbers of rows a number lies in. Their bounds, as many numbers, come to the driver."""
    marks = [k / parts for k in range(1, parts)]
    bounds = rows.agg(F.percentile_approx(column, marks, 10 * parts)).first()[0] or []
    return F.array_size(F.filter(F.lit(sorted(set(bounds))).cast("array<long>"), lambda b: b <= F.col(column))) if bounds else F.lit(0)


def document_offsets(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """document_id, tokens_before_document: a prefix sum over counts (document_id, n) in the order of ids, in two levels.

    `ids` holds the same ids and is read for the bounds of the parts alone.
    """
    counts = counts.withColumn("part", part_of(ids, "document_id"))
    parts = counts.groupBy("part").agg(F.sum("n").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return counts.join(F.broadcast(parts), "part").select("document_id", (F.col("ahead") + F.col("inner")).alias("tokens_before_document"))  # PARTS rows at most


def with_global_position(tokens: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Adds global_position, from 1 without gaps. `ids`: the documents' ids, where they can be had for less than the tokens."""
    ids = tokens.select("document_id") if ids is None else ids
    offsets = document_offsets(tokens.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), ids)
    return tokens.join(offsets, "document_id").withColumn("global_position", F.col("tokens_before_document") + F.col("stream_position")).drop("tokens_before_document")


def word_totals(tokens: DataFrame, *extra: str) -> DataFrame:
    """Per language and word (and pos, if given): least surface, frequency, range over documents; of a token table or a term_table()."""
    by = ["language", "normalized", *extra]
    # documents are counted on rows already merged within a document, which bounds what a frequent word sends
    punct = F.min(F.col("is_punctuation").cast("int")).alias("punct")
    if "n" in tokens.columns:
        # dealt first, as merging the rows of a task again would only hold them in memory
        per_document = tokens.repartition(*by, "document_id").groupBy(*by, "document_id").agg(F.min("display").alias("display"), F.sum("n").alias("n"), punct)
    else:
        per_document = tokens.groupBy(*by, "document_id").agg(F.min("surface").alias("display"), F.count(F.lit(1)).alias("n"), punct)
    return per_document.groupBy(*by).agg(F.min("display").alias("display"), F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("document_range"), F.min("punct").cast("long").alias("is_punctuation"))


def lines(documents: DataFrame, n: int) -> DataFrame:
    """Sentences of n tokens at least: document_id, language, sentence_no, tokens, words (folded), marks (whether each is punctuation), tokens_before."""
    return cut_rows(documents, "sentence", ["document_id", "language", "sentence_no", "tokens", "words", "marks", "tokens_before"]).where(F.size("tokens") >= n)


def windows(documents: DataFrame, n: int, language: str | None = None) -> DataFrame:
    """All runs of n tokens within a sentence: document_id, language, sentence_no, position, surfaces, words, has_punctuation."""
    rows = lines(documents if language is None else documents.where(F.col("lang") == language), n)
    rows = rows.withColumn("i", F.explode_outer(F.sequence(F.lit(1), F.size("tokens") - n + 1)))
    cut = lambda c: F.slice(c, F.col("i"), F.lit(n))
    return rows.select("document_id", "language", "sentence_no", (F.col("tokens_before") + F.col("i")).alias("position"), cut("tokens").alias("surfaces"), cut("words").alias("words"), F.array_contains(cut("marks"), True).alias("has_punctuation"))


def corpus_counts(documents: DataFrame) -> DataFrame:
    """One row: documents, paragraphs, sentences, tokens, types (a word of two languages is two)."""
    rows = documents.select(F.col("lang").alias("language"), F.size(X.paragraphs(F.coalesce("text", F.lit("")))).alias("p"))
    shape = rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("p").cast("long").alias("paragraphs"))
    sentences = cut_rows(documents, "sentence", ["tokens_before"]).agg(F.count(F.lit(1)).alias("sentences"))
    words = cut_rows(documents, "term", ["language", "normalized", "n"]).groupBy("language", "normalized").agg(F.sum("n").alias("n"))
    words = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types"))
    return shape.crossJoin(sentences).crossJoin(words)  # one row each


def build_counts(files: DataFrame, documents: DataFrame, pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: corpus_counts() with the numbers of files, pairs and chunks."""
    others = [d.agg(F.count(F.lit(1)).alias(n)) for n, d in (("files", files), ("pairs", pairs), ("chunks", chunks))]
    out = corpus_counts(documents)
    for other in others:
        out = out.crossJoin(other)  # one row each
    return out


def selected(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are among the wanted ones."""
    return rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def merged_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """word_totals() of two parts of a corpus that share no document, as those of the whole."""
    by = [c for c in ("language", "normalized", "pos") if c in old.columns]
    sums = [F.min("display").alias("display"), F.sum("frequency").alias("frequency"), F.sum("document_range").alias("document_range"), F.min("is_punctuation").alias("is_punctuation")]
    return old.unionByName(new).groupBy(*by).agg(*sums)


def write_index(documents: DataFrame, folder: str) -> None:
    """The token table and its aggregates as Parquet: split by language, in the order of documents and positions."""
    tokens = with_global_position(token_table(documents, offsets=True), documents.select(F.col("doc_id").alias("document_id")))
    tokens.repartitionByRange("language", "document_id").sortWithinPartitions("language", "document_id", "stream_position").write.mode("overwrite").partitionBy("language").parquet(f"{folder}/tokens")
    stored = documents.sparkSession.read.parquet(f"{folder}/tokens")
    word_totals(stored).write.mode("overwrite").partitionBy("language").parquet(f"{folder}/word_totals")
    word_totals(stored, "pos").write.mode("overwrite").partitionBy("language").parquet(f"{folder}/word_frequencies")
    document_streams(documents).write.mode("overwrite").partitionBy("language").parquet(f"{folder}/document_streams")
    documents.sparkSession.createDataFrame([(INDEX_VERSION,)], "version string").write.mode("overwrite").json(f"{folder}/meta")


def language_of(column: Column) -> Column:
    return F.when(column.rlike(r"[一-鿿]"), "zh").otherwise("en")
