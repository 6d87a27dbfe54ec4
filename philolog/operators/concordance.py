"""Concordances: phrase hits, their contexts, sorting, sampling, and full-text patterns."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from philolog.functions import text as X
from philolog.functions.segment import Lexicon, resolved
from philolog.operators import index
from philolog.plans.query import PatternTimeout, QueryError, Slot, check_pattern, may_hold, parse_simple, predicate

#: Fixed: sort keys, how many may be given, the multiplier of the sampling order.
SORT_KEYS = ("L5", "L4", "L3", "L2", "L1", "C", "R1", "R2", "R3", "R4", "R5", "FILE", "FILE_ID", "ROW_ID")
MAX_SORT_KEYS, SAMPLE_STEP, MAX_CONTEXT, MAX_LIST = 3, 1103515245, 50, 100
#: Fixed: milliseconds of a pattern on a text. A long text has them for each so many letters.
PATTERN_MS, TIMED_LETTERS = 50, 1000


def phrase_hits(tokens: DataFrame, slots: list[Slot], *, scope: str = "stream", language: str = "en", pos: str = "") -> DataFrame:
    """Where the slots match in a row: document_id, language, sentence_no, sentence_position, stream_position, token_length.

    scope `stream` lets a phrase cross the ends of sentences, `sentence` doesn't. Each slot filters
    tokens of its own, which meet in joins on position; open slots join nothing, as positions have no
    gaps: inner ones are passed over, outer ones only need room.
    """
    stream = scope == "stream"
    place, room = ("stream_position", "document_length") if stream else ("sentence_position", "sentence_length")
    unit = ["document_id", "language"] if stream else ["document_id", "language", "sentence_no"]
    closed = [i for i, s in enumerate(slots) if not s.open]
    first = closed[0] if closed else 0
    columns = ["document_id", "language", "sentence_no", "sentence_position", "stream_position", "sentence_length", "document_length"]
    condition = predicate(slots[first], language)
    if pos and first == 0:
        condition = condition & (F.col("pos") == pos)
    hits = tokens.where(condition).select(*columns).withColumn("_at", F.col(place) - first)
    hits = hits.where((F.col("_at") >= 1) & (F.col("_at") + len(slots) - 1 <= F.col(room)))
    for i in closed[1:]:
        other = tokens.where(predicate(slots[i], language)).select(*unit, (F.col(place) - i).alias("_at"))
        hits = hits.join(other, [*unit, "_at"], "left_semi")
    if first or (pos and first):
        # the hit begins at an open slot: its own row gives sentence and position
        start = tokens.where(F.col("pos") == pos) if pos else tokens
        hits = hits.select(*unit, "_at").join(start.select(*columns, F.col(place).alias("_at")), [*unit, "_at"])
    return hits.select(*columns[:5], F.lit(len(slots)).alias("token_length"), "document_length")


def row_hits(documents: DataFrame, slots: list[Slot], *, scope: str = "stream", language: str = "en", width: int = 0, context: int | None = None, places: bool = False, lexicon: Lexicon | None = None, only: list[str] | None = None) -> DataFrame:
    """The hits of phrase_hits() with what stands around them, found within each document's own row: nothing is shuffled.

    width: adds C, L<width>..L1, R1..R<width> (folded words, null beyond the document) and left_context,
    keyword and right_context (surfaces). context: adds left, keyword and right as they stand in the stream.
    places: adds paragraph_no. A lexicon cuts Chinese text; it goes with width only. only: the columns
    worked out beside document_id and language, where few are asked for.
    """
    rows = index.word_arrays(documents, offsets=context is not None, places=places, lexicon=lexicon)
    d, k = F.col("d"), len(slots)
    n = F.size(d["words"])

    def slot_holds(i: Column, j: int, slot: Slot) -> Column:
        def value(_, name: str) -> Column:
            return F.get(d["surfaces" if name == "surface" else "words"], i + (j - 1)) if name in ("surface", "normalized") else F.lit("")

        return predicate(slot, language, value)

    def holds(i: Column) -> Column:
        closed = [slot_holds(i, j, s) for j, s in enumerate(slots) if not s.open]
        return reduce(Column.__and__, closed) if closed else F.lit(True)

    def sentence(p: Column) -> Column:
        return F.size(F.filter(d["before"], lambda b: b < p))

    at = F.when(n >= k, F.filter(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), holds)).otherwise(F.array().cast("array<int>"))
    if scope == "sentence":
        at = F.filter(at, lambda i: sentence(i) == sentence(i + (k - 1)))

    def run(name: str, low: Column, high: Column) -> Column:
        low = F.greatest(low, F.lit(1))
        return F.array_join(F.slice(d[name], low, F.greatest(high - low + 1, F.lit(0))), " ")

    def described(i: Column) -> Column:
        last = i + (k - 1)
        out = {"sentence_no": sentence(i).cast("long"), "sentence_position": i.cast("long") - F.element_at(d["before"], sentence(i)), "stream_position": i.cast("long"), "token_length": F.lit(k), "document_length": n.cast("long")}
        if places:
            out |= {"paragraph_no": F.size(F.filter(d["paragraphs"], lambda b: b < i)).cast("long")}
        if width:
            out |= {"left_context": run("surfaces", i - width, i - 1), "keyword": run("surfaces", i, last), "right_context": run("surfaces", last + 1, last + width)}
            out |= {f"L{m}": F.get(d["words"], i - (1 + m)) for m in range(width, 0, -1)} | {"C": F.get(d["words"], i - 1)} | {f"R{m}": F.get(d["words"], last + (m - 1)) for m in range(1, width + 1)}
        if context is not None:
            start, end = F.element_at(d["starts"], i), F.element_at(d["ends"], last)
            first, final = F.element_at(d["starts"], F.greatest(i - context, F.lit(1))), F.element_at(d["ends"], F.least(last + context, n))
            cut = lambda x, y: F.substring(d["stream"], (x + 1).cast("int"), (y - x).cast("int"))
            out |= {"left": X.display_fragment(cut(first, start), language), "keyword": cut(start, end), "right": X.display_fragment(cut(end, final), language)}
        return F.struct(*[c.alias(name) for name, c in out.items() if only is None or name in only])

    return rows.select("document_id", "language", F.explode(F.transform(at, described)).alias("h")).select("document_id", "language", "h.*")


def chinese_hits(documents: DataFrame, query: str, lexicon: Lexicon | None, *, whole_words: bool = True, case_sensitive: bool = False, regular: bool = False, width: int = 5) -> DataFrame:
    """Hits in Chinese documents: of the query as one token if there is any, else of its words one after the other.

    Without a lexicon a run of letters is one token, and a query's characters are sought one by one.
    """
    own = documents.where("lang = 'zh'")

    def found(slots: list[Slot]) -> bool:
        return not row_hits(own.where(may_hold(F.col("text"), slots)), slots, language="zh", lexicon=lexicon).isEmpty()

    slots = resolved(query, lexicon, found, whole_words=whole_words, case_sensitive=case_sensitive, regular=regular)
    return row_hits(own.where(may_hold(F.col("text"), slots)), slots, language="zh", width=width, lexicon=lexicon)


def with_neighbours(hits: DataFrame, tokens: DataFrame, left: int = 5, right: int = 5) -> DataFrame:
    """Adds L<left>..L1, C and R1..R<right> (folded words, null beyond the document), and keyword, left_context, right_context (surfaces).

    Hits ask for the positions they need, which meet tokens in one join; nothing is windowed over all tokens.
    """
    key = ["document_id", "language", "stream_position", "token_length"]
    asked = hits.withColumn("_off", F.explode(F.sequence(F.lit(-left), F.col("token_length") + right - 1))).withColumn("_p", F.col("stream_position") + F.col("_off"))
    words = tokens.select("document_id", "language", F.col("stream_position").alias("_p"), "surface", "normalized")
    met = asked.join(words, ["document_id", "language", "_p"])
    side = F.when(F.col("_off") < 0, F.col("_off")).when(F.col("_off") < F.col("token_length"), 0).otherwise(F.col("_off") - F.col("token_length") + 1)
    met = met.withColumn("_side", side)

    def of(k: int) -> Column:
        return F.max(F.when(F.col("_side") == k, F.col("normalized")))

    def text(condition: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(condition, F.struct("_off", "surface"))))
        return F.array_join(F.transform(ordered, lambda x: x["surface"]), " ")

    rest = [c for c in hits.columns if c not in key]
    return met.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in rest],
        text(F.col("_side") < 0).alias("left_context"), text(F.col("_side") == 0).alias("keyword"), text(F.col("_side") > 0).alias("right_context"),
        *[of(-k).alias(f"L{k}") for k in range(left, 0, -1)], F.max(F.when(F.col("_off") == 0, F.col("normalized"))).alias("C"), *[of(k).alias(f"R{k}") for k in range(1, right + 1)],
    )


def pattern_frequency(hits: DataFrame, keys: list[str], *, spread: bool = False) -> DataFrame:
    """Adds kpf: how many hits share the values of the sort keys; 1 without keys.

    spread: hits are read twice and meet their counts in a join, so that those of a frequent word are
    not rows of one task.
    """
    names = ["document_id" if k in ("FILE", "FILE_ID") else "stream_position" if k == "ROW_ID" else k for k in keys]
    if spread and names:
        counts = hits.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).alias("kpf"))
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)]
        return hits.join(counts, reduce(Column.__and__, same)).drop(*[f"_k{i}" for i in range(len(names))])
    return hits.withColumn("kpf", F.count(F.lit(1)).over(Window.partitionBy(*names)) if names else F.lit(1).cast("long"))


def check_sort_keys(keys: list[str]) -> list[str]:
    out = list(dict.fromkeys(k.strip().upper() for k in keys if k.strip()))
    if unknown := [k for k in out if k not in SORT_KEYS]:
        raise ValueError(f"unknown sort key {unknown[0]}")
    if len(out) > MAX_SORT_KEYS:
        raise ValueError(f"more than {MAX_SORT_KEYS} sort keys")
    return out


def sort_columns(keys: list[str], by_frequency: bool = False) -> list[Column]:
    """Missing neighbours come last, ties by document and position."""
    out = [F.col("kpf").desc()] if by_frequency and keys else []
    for k in keys:
        name = "document_id" if k in ("FILE", "FILE_ID") else "stream_position" if k == "ROW_ID" else k
        out += [F.col(name).isNull(), F.col(name)]
    return [*out, F.col("document_id"), F.col("stream_position")]


def sampled(hits: DataFrame, size: int, seed: int) -> DataFrame:
    """The `size` hits first in a seeded order of their global positions."""
    mark = (F.col("global_position") * SAMPLE_STEP + seed).bitwiseAND(2147483647)
    return hits.withColumn("_mark", mark).orderBy("_mark", "global_position").limit(size).drop("_mark")


@dataclass
class Page:
    total: int
    page: int
    pages: int
    rows: DataFrame


def paged(rows: DataFrame, order: list[Column], page: int, size: int) -> Page:
    """One page; beyond the last page the last one."""
    total = rows.count()
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    return Page(total, page, pages, rows.orderBy(*order).offset((page - 1) * size).limit(size))


@dataclass
class Kwic:
    """Options of a concordance; apply to documents with hits()."""

    query: str
    language: str = "en"
    context: int = 5
    sort_keys: list[str] = field(default_factory=list)
    by_frequency: bool = False
    pos: str = ""
    whole_words: bool = True
    case_sensitive: bool = False
    regular: bool = False
    sample: int = 0
    seed: int = 0

    def slots(self) -> list[Slot]:
        return parse_simple(self.query, whole_words=self.whole_words, case_sensitive=self.case_sensitive, regular=self.regular)

    def hits(self, documents: DataFrame, *, places: bool = False, only: list[str] | None = None) -> DataFrame:
        if not 0 <= self.context <= MAX_CONTEXT:
            raise ValueError(f"context of 0 to {MAX_CONTEXT} tokens")
        return concordance(documents, self.slots(), self, places=places, only=only)


def concordance(documents: DataFrame, slots: list[Slot], options: Kwic, *, places: bool = False, only: list[str] | None = None) -> DataFrame:
    """Hits of any slots with contexts and kpf, and with places (but for queries by pos) paragraph_no. Only documents that can hold a hit are cut into tokens, unless positions in the corpus are asked for. only: as in row_hits(); sort keys are among them."""
    keys = check_sort_keys(options.sort_keys)
    own = documents.where(F.col("lang") == options.language)
    width = max(options.context, 5 if keys else 0)
    if options.pos:
        tokens = index.token_table(own.where(may_hold(F.col("text"), slots)))
        hits = with_neighbours(phrase_hits(tokens, slots, language=options.language, pos=options.pos), tokens, width, width)
    else:
        hits = row_hits(own.where(may_hold(F.col("text"), slots)), slots, language=options.language, width=width, places=places, only=only)
    if options.sample:
        offsets = index.document_offsets(index.word_counts(documents), documents.select(F.col("doc_id").alias("document_id")))
        hits = hits.join(offsets, "document_id").withColumn("global_position", F.col("tokens_before_document") + F.col("stream_position")).drop("tokens_before_document")
        hits = sampled(hits, options.sample, options.seed)
    return pattern_frequency(hits, keys)


def union_hits(parts: list[DataFrame]) -> DataFrame:
    """Hits of several queries; of equal place and length one stays."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["document_id", "language", "stream_position", "token_length"])


def filter_by_context(hits: DataFrame, tokens: DataFrame, conditions: list[Slot], *, low: int, high: int, every: bool = False, exclude: bool = False, language: str = "en") -> DataFrame:
    """Hits with a token that meets any (or every) condition at an offset within low..high, or those without.

    Offsets count from the keyword's ends: -1 is just before, 1 just after, 0 is passed over.
    """
    if len(conditions) > MAX_LIST:
        raise QueryError(f"more than {MAX_LIST} conditions")
    key = ["document_id", "language", "stream_position", "token_length"]
    found = []
    for n, slot in enumerate(conditions):
        near = tokens.where(predicate(slot, language)).select("document_id", "language", F.col("stream_position").alias("_p"))
        asked = hits.select(*key, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_o")).where("_o != 0")
        asked = asked.withColumn("_p", F.col("stream_position") + F.when(F.col("_o") < 0, F.col("_o")).otherwise(F.col("_o") + F.col("token_length") - 1))
        found.append(asked.join(near, ["document_id", "language", "_p"], "left_semi").select(*key, F.lit(n).alias("_n")))
    met = reduce(DataFrame.union, found).groupBy(*key).agg(F.countDistinct("_n").alias("_met"))
    met = met.where(F.col("_met") == len(conditions)) if every else met
    return hits.join(met.select(*key), key, "left_anti" if exclude else "left_semi")


def _seconds(text: str, limit_ms: float) -> float:
    """Time for a pattern on a text: limit_ms for each TIMED_LETTERS of it, begun ones too."""
    return limit_ms / 1000 * (1 + len(text) // TIMED_LETTERS)


def matching_surfaces(surfaces: DataFrame, pattern: str, *, case_sensitive: bool = False, whole: bool = True, limit_ms: float = PATTERN_MS, column: str = "surface") -> DataFrame:
    """The distinct surfaces that a pattern fits, each tried once, within limit_ms."""
    check_pattern(pattern)
    compiled = regex.compile(pattern, 0 if case_sensitive else regex.IGNORECASE)

    @F.pandas_udf("boolean")
    def fits(words: pd.Series) -> pd.Series:
        def one(word: str) -> bool:
            try:
                return bool((compiled.fullmatch if whole else compiled.search)(word, timeout=_seconds(word, limit_ms)))
            except TimeoutError:
                raise PatternTimeout(f"more than {limit_ms:g} ms for a token") from None

        return words.map(one)

    return surfaces.select(column).distinct().where(F.col(column).isNotNull()).where(fits(column))


def pattern_tokens(tokens: DataFrame, pattern: str, *, case_sensitive: bool = False, whole: bool = True, limit_ms: float = PATTERN_MS) -> DataFrame:
    """Tokens whose surface a pattern fits: the pattern runs on distinct surfaces, which then meet the tokens."""
    return tokens.join(matching_surfaces(tokens, pattern, case_sensitive=case_sensitive, whole=whole, limit_ms=limit_ms), "surface", "left_semi")


def pattern_hits(documents: DataFrame, pattern: str, *, language: str = "en", case_sensitive: bool = False, limit_ms: float = PATTERN_MS) -> DataFrame:
    """Hits of a pattern in whole document streams: start, end (code points), text, first token and number of tokens.

    Spans without length, and those that meet no token, are no hits. One Arrow pass over documents; a
    document's spans find their tokens by bisection in its own token offsets. A pattern that takes more
    than limit_ms for each TIMED_LETTERS of a text fails: see pattern_errors().
    """
    check_pattern(pattern, 500)
    compiled = regex.compile(pattern, 0 if case_sensitive else regex.IGNORECASE)
    token = regex.compile(X.TOKEN)

    def hits_of(text: str) -> list[dict]:
        try:
            found = [m for m in compiled.finditer(text, timeout=_seconds(text, limit_ms)) if m.end() > m.start()]
        except TimeoutError:
            raise PatternTimeout(f"more than {_seconds(text, limit_ms):g} s for a text of {len(text)} letters") from None
        edges = [m.span() for m in token.finditer(text)] if found else []
        starts, ends = [a for a, _ in edges], [b for _, b in edges]
        out = []
        for m in found:
            first, last = bisect_right(ends, m.start()), bisect_left(starts, m.end())
            if first < last:
                out.append({"start": m.start(), "end": m.end(), "text": m.group(), "stream_position": first + 1, "token_length": last - first})
        return out

    @F.pandas_udf("array<struct<start:int,end:int,text:string,stream_position:long,token_length:long>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(hits_of)

    own = documents.where(F.col("lang") == language)
    return index.document_streams(own).select("document_id", "language", F.explode(spans("text")).alias("s")).select("document_id", "language", "s.*")


def snippets(documents: DataFrame, slots: list[Slot], context: int = 5, *, language: str = "en") -> DataFrame:
    """Hits with left, keyword and right as they stand in the document's stream."""
    hits = row_hits(documents.where(F.col("lang") == language).where(may_hold(F.col("text"), slots)), slots, language=language, context=context)
    return hits.select("document_id", "language", "stream_position", "token_length", "left", "keyword", "right")


def file_view(documents: DataFrame, document_id: int, spans: DataFrame) -> DataFrame:
    """One row for a document: token and type counts, and its stream as (text, matched) pieces.

    spans has document_id, start and end; a span that begins within the one before is passed over.
    """
    own = documents.where(F.col("doc_id") == document_id)
    counts = index.token_table(own).groupBy("document_id").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("normalized").alias("types"))
    marks = spans.where(F.col("document_id") == document_id).groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("marks"))

    @F.pandas_udf("array<struct<text:string,matched:boolean>>")
    def pieces(texts: pd.Series, marks: pd.Series) -> pd.Series:
        """One pass over a text and its spans in order."""

        def cut(text: str, spans) -> list[dict]:
            out, at = [], 0
            for span in spans if spans is not None else ():
                if span["start"] >= at:
                    out += [{"text": text[at : span["start"]], "matched": False}, {"text": text[span["start"] : span["end"]], "matched": True}]
                    at = span["end"]
            return [p for p in (*out, {"text": text[at:], "matched": False}) if p["text"]]

        return pd.Series([cut(t, m) for t, m in zip(texts, marks, strict=True)])

    view = index.document_streams(own).join(marks, "document_id", "left")
    return view.select("document_id", pieces("text", "marks").alias("segments")).join(counts, "document_id", "left")
