"""A stored positional index: postings by term and document, and the documents' words beside them.

postings has a row for each term of some documents with its positions in each, in the order of terms, so
that a term asked for reaches the scan and picks the row groups that hold it. words has each document's
surfaces and sentence borders, from which contexts are cut, and terms what lists and measures need of
the whole corpus. Building shuffles postings once; a query reads the postings of its own terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from philolog.functions import text as X
from philolog.functions.measures import Contingency, ratio
from philolog.functions.segment import Lexicon, resolved
from philolog.operators import index
from philolog.plans.query import QueryError, Slot, parse_simple, predicate
from philolog.sources import versions

TABLES = ("postings", "words", "terms")
COLUMNS = ["language", "term", "frequency", "document_range", "display", "is_punctuation", "surfaces", "document_ids", "positions"]
#: Tokens whose terms are found at once where a lexicon cut them, and the parts over which a term's documents are dealt.
TOKENS_AT_ONCE, SPREAD = 200_000, 16


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents' word arrays a row for each term of a document, some documents at a time."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("words")).fill_null(0).to_numpy(zero_copy_only=False)
        marks = np.flatnonzero(np.diff(np.cumsum(sizes) // TOKENS_AT_ONCE, prepend=0))
        for low, high in zip([0, *marks], [*marks, len(batch)], strict=True):
            if sizes[low:high].any():
                yield _terms_of(batch.slice(low, high - low), sizes[low:high])


def _terms_of(batch: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
    words, surfaces = (batch.column(c).flatten().dictionary_encode() for c in ("words", "surfaces"))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    key = row * len(words.dictionary) + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")  # by document and term, then by position
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    first = order[starts]
    # a surface's first place in its run; places in the order of bytes tell the least one
    run, surface = np.repeat(np.arange(len(starts)), ends - starts), surfaces.indices.to_numpy()[order]
    kept = np.sort(np.unique(run * len(surfaces.dictionary) + surface, return_index=True)[1])
    by_bytes = pc.sort_indices(surfaces.dictionary.cast("binary")).to_numpy()
    place = np.empty_like(by_bytes)
    place[by_bytes] = np.arange(len(by_bytes))
    least = by_bytes[np.minimum.reduceat(place[surface], starts)]

    def lists(values: pa.Array, upto: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), values)

    columns = {
        "language": batch.column("language").take(row[first]), "term": words.dictionary.take(words.indices.to_numpy()[first]), "document_id": batch.column("document_id").take(row[first]), "n": pa.array(ends - starts, pa.int64()),
        "display": surfaces.dictionary.take(least), "surfaces": lists(surfaces.dictionary.take(surface[kept]), np.cumsum(np.bincount(run[kept], minlength=len(starts)))), "positions": lists(pa.array(at[order], pa.int32()), ends),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def postings(words: DataFrame) -> DataFrame:
    """COLUMNS of rows of word arrays: a row for each term of a document, found within the document's own row."""
    own = words.select("document_id", "language", "surfaces", "words")
    number = own.schema["document_id"].dataType.simpleString()
    rows = own.mapInArrow(_runs, f"language string, term string, document_id {number}, n long, display string, surfaces array<string>, positions array<int>")
    one = F.lit(1).cast("long").alias("document_range")
    return rows.select("language", "term", F.col("n").alias("frequency"), one, "display", X.is_punctuation(F.col("display")).alias("is_punctuation"), "surfaces", F.array("document_id").alias("document_ids"), F.array("positions").alias("positions"))


def of_texts(documents: DataFrame) -> DataFrame:
    """COLUMNS of documents (doc_id, text, lang): a row for each term of some documents of a language, found as their texts are cut."""
    return index.cut_rows(documents, "posting", COLUMNS)


def _terms(found: DataFrame) -> DataFrame:
    return found.groupBy("language", "term").agg(F.min("display").alias("display"), F.sum("frequency").alias("frequency"), F.sum("document_range").alias("document_range"), F.min(F.col("is_punctuation").cast("int")).cast("boolean").alias("is_punctuation"))


def build(documents: DataFrame, folder: str, lexicon: Lexicon | None = None) -> PositionalIndex:
    """Writes the index of documents (doc_id, text, lang) as a new version of folder, and opens it. A lexicon cuts Chinese text.

    Texts are cut once for the words and once for the postings, which are shuffled once: by hash, as
    bounds of ranges would ask for another cut. A term's rows are dealt over SPREAD parts, each in the
    order of terms. Terms are counted from the postings as they were written, without their positions.
    """
    spark = documents.sparkSession
    before = versions.current(spark, folder)
    if lexicon is None:
        words, found = index.cut_rows(documents, "document", ["document_id", "language", "surfaces", "before"]), of_texts(documents)
    else:
        words = index.word_arrays(documents, lexicon=lexicon).select("document_id", "language", "d.surfaces", "d.words", "d.before")
        found = postings(words)
    found = found.repartition("language", "term", F.pmod(F.hash(F.get("document_ids", F.lit(0))), F.lit(SPREAD))).sortWithinPartitions("language", "term")
    tables = {"words": words.drop("words").sortWithinPartitions("document_id"), "postings": found, "terms": lambda written: _terms(written["postings"])}
    made = versions.publish(tables, folder, after=before, partition_by={t: ["language"] for t in TABLES})
    return PositionalIndex(spark, made)


def opened(spark: SparkSession, folder: str) -> PositionalIndex:
    """The newest version of a stored index."""
    version = versions.current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"{folder} holds no index")
    return PositionalIndex(spark, version)


def of_documents(documents: DataFrame, name: str) -> PositionalIndex:
    """The index of these documents in the session's shared folder: built once for the application, then read."""
    spark = documents.sparkSession
    mark = hashlib.sha256(f"{spark.sparkContext.applicationId}\n{name}\n{documents.schema.simpleString()}".encode()).hexdigest()[:24]
    folder = f"{versions.workspace(spark)}/index-{mark}"
    version = versions.current(spark, folder)
    return PositionalIndex(spark, version) if version else build(documents, folder)


def _slots(query: str | list[Slot]) -> list[Slot]:
    slots = parse_simple(query) if isinstance(query, str) else query
    if all(s.open for s in slots):
        raise QueryError("a query of the index names one term at least")
    if any(s.attribute == "pos" for s in slots):
        raise QueryError("the index holds no parts of speech")
    return slots


def _by_surface(slot: Slot) -> bool:
    return not slot.open and (slot.case_sensitive or slot.kind in ("regex", "full"))


def _of_postings(slot: Slot, language: str) -> Column:
    """The slot as a condition on postings: on the term where that tells, else on any of its surfaces."""
    if not _by_surface(slot):
        return predicate(slot, language, lambda _, __: F.col("term"))
    some = F.exists("surfaces", lambda x: predicate(slot, language, lambda _, __: x))
    return some & (F.col("term") == slot.value.casefold()) if slot.kind == "exact" else some


def _moved(k: int) -> Column:
    return F.transform("positions", lambda p: p - k)


@dataclass
class PositionalIndex:
    spark: SparkSession
    version: versions.Version

    def table(self, name: str, language: str) -> DataFrame:
        return self.version.table(self.spark, name).where(F.col("language") == language)

    def positions(self, query: str | list[Slot], language: str = "en") -> DataFrame:
        """document_id, at: where the query's terms may stand one after the other, in a document's stream; token_length.

        Reads the postings of the query's terms alone. A phrase is the intersection of its terms'
        positions, each moved back to the phrase's start; open slots ask for room, not for postings.
        For patterns and for slots that mind case these are candidates, as a posting tells the
        surfaces of its term in its documents, not which stands where.
        """
        slots = _slots(query)
        conditions = {k: _of_postings(s, language) for k, s in enumerate(slots) if not s.open}
        own = self.table("postings", language).where(reduce(Column.__or__, conditions.values()))
        own = own.select("term", "surfaces", F.explode(F.arrays_zip("document_ids", "positions")).alias("z")).select("term", "surfaces", F.col("z.document_ids").alias("document_id"), "z.positions")
        if len(conditions) == 1 and slots[k := next(iter(conditions))].kind == "exact":
            rows = own.select("document_id", _moved(k).alias("at"))
        else:
            moved = [F.flatten(F.collect_list(F.when(c, _moved(k)))).alias(f"at_{k}") for k, c in conditions.items()]
            rows = own.groupBy("document_id").agg(*moved)
            rows = rows.select("document_id", F.array_sort(reduce(F.array_intersect, [F.col(f"at_{k}") for k in conditions])).alias("at"))
        return rows.select("document_id", F.filter("at", lambda p: p >= 1).alias("at"), F.lit(len(slots)).alias("token_length")).where(F.size("at") > 0)

    def _hits(self, query: str | list[Slot], language: str) -> DataFrame:
        """positions() with the words of their documents; what goes beyond a document's end, or doesn't fit by its surface, left out. Documents without a candidate are not joined."""
        slots = _slots(query)
        found = self.positions(slots, language)
        rows = self.table("words", language).select("document_id", "surfaces", "before").join(found, "document_id")

        def fits(p: Column) -> Column:
            out = p + F.col("token_length") - 1 <= F.size("surfaces")
            for k, slot in enumerate(slots):
                if _by_surface(slot):
                    surface = F.get("surfaces", p + (k - 1))
                    out = out & F.coalesce(predicate(slot, language, lambda _, name, x=surface: x if name == "surface" else X.casefold(x)), F.lit(False))
            return out

        return rows.withColumn("at", F.filter("at", fits)).where(F.size("at") > 0)

    def kwic(self, query: str | list[Slot], language: str = "en", context: int = 5) -> DataFrame:
        """document_id, sentence_no, stream_position, token_length, left_context, keyword, right_context: as concordances of row_hits() have them."""

        def described(p: Column) -> Column:
            cut = lambda low, high: F.array_join(F.slice("surfaces", F.greatest(low, F.lit(1)), F.greatest(high - F.greatest(low, F.lit(1)) + 1, F.lit(0))), " ")
            last = p + F.col("token_length") - 1
            return F.struct(F.size(F.filter("before", lambda b: b < p)).cast("long").alias("sentence_no"), p.cast("long").alias("stream_position"), cut(p - context, p - 1).alias("left_context"), cut(p, last).alias("keyword"), cut(last + 1, last + context).alias("right_context"))

        rows = self._hits(query, language).select("document_id", "token_length", F.explode(F.transform("at", described)).alias("h"))
        return rows.select("document_id", "h.sentence_no", "h.stream_position", "token_length", "h.left_context", "h.keyword", "h.right_context")

    def chinese(self, query: str, lexicon: Lexicon | None, *, case_sensitive: bool = False) -> list[Slot]:
        """Slots of a Chinese term: as one token if the index has such a posting, else its words."""
        return resolved(query, lexicon, lambda slots: not self.positions(slots, "zh").isEmpty(), case_sensitive=case_sensitive)

    def collocates(self, query: str | list[Slot], language: str = "en", *, left: int = 5, right: int = 5, min_frequency: int = 1, min_range: int = 1, punctuation: bool = False) -> DataFrame:
        """Words near the query's hits within their sentences, with the columns and measures of collocation.collocates().

        Spans are cut within the documents' rows, and the whole corpus's counts are read from terms:
        neither tokens nor texts are shuffled.
        """
        if left < 0 or right < 0 or left + right == 0:
            raise ValueError("one span at least must be positive")

        def near(p: Column) -> Column:
            last = p + F.col("token_length") - 1
            low = F.coalesce(F.array_max(F.filter("before", lambda b: b < p)), F.lit(0)) + 1
            high = F.coalesce(F.array_min(F.filter("before", lambda b: b >= p)), F.size("surfaces").cast("long"))
            side = lambda a, b, is_left: F.transform(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>")), lambda i: F.struct(F.get("surfaces", (i - 1).cast("int")).alias("surface"), F.lit(is_left).alias("is_left")))
            spans = F.concat(side(F.greatest(low, (p - left).cast("long")), (p - 1).cast("long"), True), side((last + 1).cast("long"), F.least(high, (last + right).cast("long")), False))
            return F.when(last <= high, spans).otherwise(F.array().cast("array<struct<surface:string,is_left:boolean>>"))

        rows = self._hits(query, language).select("document_id", F.explode(F.flatten(F.transform("at", near))).alias("c")).select("document_id", "c.*")
        rows = rows if punctuation else rows.where(~X.is_punctuation(F.col("surface")))
        per = rows.groupBy(X.casefold(F.col("surface")).alias("term"), "document_id").agg(F.min("surface").alias("display"), F.count(F.lit(1)).alias("n"), F.sum(F.col("is_left").cast("long")).alias("l"))
        observed = per.groupBy("term").agg(F.min("display").alias("display"), F.sum("n").alias("frequency"), F.sum("l").alias("left_frequency"), F.count(F.lit(1)).alias("document_range"))
        opportunities = observed.agg(F.sum("frequency").alias("opportunities"))
        corpus = self.terms(language, punctuation=punctuation).select("term", F.col("frequency").alias("corpus_frequency"))
        size = corpus.agg(F.sum("corpus_frequency").alias("size"))
        rows = observed.where((F.col("frequency") >= min_frequency) & (F.col("document_range") >= min_range)).join(corpus, "term").crossJoin(F.broadcast(opportunities)).crossJoin(F.broadcast(size))  # one row each
        joint = F.least("frequency", "opportunities", "corpus_frequency")
        table = Contingency.from_marginals(joint, F.col("opportunities"), F.col("corpus_frequency"), F.greatest(F.col("size"), F.col("opportunities") + F.col("corpus_frequency") - joint))
        return rows.select("term", "display", F.lit("").alias("pos"), "frequency", "left_frequency", (F.col("frequency") - F.col("left_frequency")).alias("right_frequency"), "document_range", "corpus_frequency", *[c.alias(k) for k, c in table.measures().items()])

    def terms(self, language: str = "en", *, punctuation: bool = False) -> DataFrame:
        rows = self.table("terms", language)
        return rows if punctuation else rows.where(~F.col("is_punctuation"))

    def word_list(self, language: str = "en", *, min_frequency: int = 1, min_range: int = 1, contains: str = "", punctuation: bool = False) -> DataFrame:
        """The static list, read from terms: term, display, frequency, document_range, per_million."""
        own = self.terms(language, punctuation=punctuation)
        size = own.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("size"))
        rows = own.where((F.col("frequency") >= min_frequency) & (F.col("document_range") >= min_range))
        rows = rows.where(F.col("term").contains(contains.casefold())) if contains else rows
        return rows.crossJoin(F.broadcast(size)).select("term", "display", "frequency", "document_range", ratio(F.col("frequency") * 1e6, F.col("size")).alias("per_million"))  # one row

    def plot_bins(self, query: str | list[Slot], language: str = "en", bins: int = 50) -> DataFrame:
        """document_id, bin (from 0), hits: where in each document the query's hits lie, those that cross a sentence's end left out."""
        inside = F.filter("at", lambda p: ~F.exists("before", lambda b: (b >= p) & (b < p + F.col("token_length") - 1)))
        span = F.size("surfaces") - 1
        place = F.when(span == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("p") - 1) * (bins - 1) / span)))
        rows = self._hits(query, language).select("document_id", "surfaces", F.explode(inside).alias("p"))
        return rows.groupBy("document_id", place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("hits"))
