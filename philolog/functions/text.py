"""Text primitives as Column builders. Whitespace is Unicode's throughout."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from philolog.functions.cutting import SENTENCE_END, SENTENCE_END_ZH

#: Fixed: a token is a word with inner apostrophes or hyphens, a number with inner separators, or one symbol.
TOKEN = r"\p{L}+(?:['’\-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*|[^\p{L}\p{N}\s\u0085\p{Z}]"
#: Fixed word lists.
ENGLISH_STOPWORDS = """
a an and any are as at be been being but by can could did do does for from had has have he her hers him his how i if
in is it its may might must no nor not of on or our ours shall she should some than that the their theirs them then
there these they this those to us was we were what when where which who whom why will with would you your yours
""".split()
CHINESE_STOPWORDS = "的 了 和 是 在 有 与 及 或 而 被 把 将 对 为 以 于 从 到 中 上 下 这 那 一个 一种 我们 他们 你们".split()
_SPACES = r"[\s\u0085\p{Z}]+"


def compact(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def _folded_letters() -> dict[str, str]:
    """Letters that full case folding changes though they are lower case already, by the Unicode tables at hand."""
    lower = (c for c in map(chr, range(0x80, 0x110000)) if c.lower() == c)
    return {c: f for c in lower if (f := c.casefold()) != c}


FOLDED = _folded_letters()
_ONE = {c: f for c, f in FOLDED.items() if len(f) == 1}
_MORE = {c: f for c, f in FOLDED.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full case folding: lower case, then what it leaves (final sigma, ß, ligatures and the like). Plain ASCII stops at lower case."""
    low = F.lower(text)
    one = F.translate(low, "".join(_ONE), "".join(_ONE.values()))
    pairs = F.array(*[F.struct(F.lit(c).alias("a"), F.lit(f).alias("b")) for c, f in _MORE.items()])
    more = F.when(one.rlike(f"[{''.join(_MORE)}]"), F.aggregate(pairs, one, lambda t, m: F.replace(t, m["a"], m["b"]))).otherwise(one)
    return F.when(low.rlike(r"[^\x00-\x7F]"), more).otherwise(low)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed; empty ones are left out."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    parts = F.transform(F.split(lines, r"\n\s*\n+"), lambda p: F.regexp_replace(p, f"^{_SPACES}|{_SPACES}$", ""))
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column, language: Column) -> Column:
    whole = compact(text)
    cut = F.when(language == "zh", F.split(whole, SENTENCE_END_ZH)).otherwise(F.split(whole, SENTENCE_END))
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Surfaces of all tokens. Han text has no blanks: without a segmenter a run of letters is one token."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_gaps(text: Column) -> Column:
    """What stands before, between and after the tokens: one entry more than tokens()."""
    return F.split(text, TOKEN, -1)


def is_punctuation(surface: Column) -> Column:
    return surface.rlike(r"^[\p{P}\p{S}]+$")


def running(lengths: Column, chunk: int = 256) -> Column:
    """Sums of all entries before each entry; summed in chunks, so a long array costs little more than a pass."""
    zero = F.array(F.lit(0).cast("long"))

    def before(of: Column) -> Column:
        return F.aggregate(of, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(chunk)), lambda i: F.slice(lengths, i, F.lit(chunk)))
    starts = before(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)))
    inner = F.transform(parts, lambda p: F.slice(before(p), F.lit(1), F.size(p)))
    return F.flatten(F.zip_with(F.slice(starts, F.lit(1), F.size(parts)), inner, lambda s, p: F.transform(p, lambda x: x + s)))


def display_fragment(text: Column, language: str) -> Column:
    return F.regexp_replace(text, _SPACES, "") if language == "zh" else compact(text)


def light_stem(word: Column) -> Column:
    """English plurals taken back."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y")))
        .when((n > 4) & word.rlike("(?:ch|sh|x|z|ss)es$"), F.left(word, n - 2))
        .when((n > 3) & word.rlike("(?<![isu])s$"), F.left(word, n - 1))
        .otherwise(word)
    )


def candidate_terms(text: Column, language: str) -> Column:
    """array<struct<key, surface>> of content words."""
    english = language == "en"
    stop = F.array(*map(F.lit, ENGLISH_STOPWORDS if english else CHINESE_STOPWORDS))
    least = 3 if english else 2
    words = F.transform(tokens(text), lambda t: F.struct(casefold(t).alias("folded"), t.alias("surface")))
    kept = F.filter(words, lambda w: (F.length(w["folded"]) >= least) & ~F.array_contains(stop, w["folded"]))
    return F.transform(kept, lambda w: F.struct((light_stem(w["folded"]) if english else w["folded"]).alias("key"), (w["folded"] if english else w["surface"]).alias("surface")))


def retrieval_terms(text: Column) -> Column:
    """Folded tokens of two letters or digits at least; words with inner marks don't count."""
    return F.filter(F.transform(tokens(text), casefold), lambda t: (F.length(t) > 1) & t.rlike(r"^[\p{L}\p{N}]+$"))


def audit_form(text: Column) -> Column:
    return compact(F.lower(text))


def symbol_units(text: Column) -> Column:
    """Characters that are neither white space, punctuation nor symbols."""
    return F.length(F.regexp_replace(text, r"[\p{P}\p{S}\s\u0085\p{Z}]", ""))


def word_units(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _SPACES, ""))


def spreadsheet_safe(value: Column) -> Column:
    """A leading apostrophe keeps a cell from being read as a formula."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def clip(value: Column, most: int) -> Column:
    return F.substring(value, 1, most)


def bounded(value: Column, most_entries: int, most_letters: int) -> Column:
    """A map of strings with its first entries by key, each value clipped."""
    kept = F.slice(F.array_sort(F.map_entries(value)), 1, most_entries)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], F.substring(e["value"], 1, most_letters).alias("value"))))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), F.lit(32)))


#: Fixed: where a chunk may end, and the most characters it may have.
CHUNK_ENDS, CHUNK_LIMIT = "。！？!?;；,， ", 1800


def chunks(text: Column, limit: int = CHUNK_LIMIT) -> Column:
    """Chunks of at most `limit` characters: each ends with the last mark it can, unless that would leave less than a third.

    One pattern takes a chunk at a time. While more than `limit` characters are left, its first branch
    reaches for the last mark, its second takes a full chunk; the last chunk is what remains.
    """
    marks, third = re.escape(CHUNK_ENDS), max(1, limit // 3)
    long = rf"(?s)(?=.{{{limit + 1}}})(?:.{{{third},{limit}}}[{marks}]|.{{{limit}}})\x20?|(?s).+"
    parts = F.regexp_extract_all(compact(text), F.lit(long), F.lit(0))
    return F.filter(F.transform(parts, lambda c: F.trim(c)), lambda c: c != "")


_TOKEN = regex.compile(TOKEN)


def literal_spans(text: str, term: str, case_sensitive: bool, whole_words: bool, token_borders: bool = False) -> list[tuple[int, int]]:
    """Spans of a term in a text, not overlapping; folded letters may be longer than the ones they stand for.

    With whole_words the characters beside a span may not be letters if the span ends in one itself;
    with token_borders as well, a span must begin where a token begins and end where one ends.
    """
    if not text or not term:
        return []
    if case_sensitive:
        folded, where = text, None
    else:
        term = term.casefold()
        folded = text.casefold()
        where = None if len(folded) == len(text) else [i for i, c in enumerate(text) for _ in c.casefold()]
    out, at = [], folded.find(term)
    while at >= 0:
        start = at if where is None else where[at]
        end = at + len(term) if where is None else where[at + len(term) - 1] + 1
        before, after = text[start - 1 : start], text[end : end + 1]
        if not whole_words or not (before.isalpha() and text[start].isalpha() or after.isalpha() and text[end - 1].isalpha()):
            if not out or start >= out[-1][1]:
                out.append((start, end))
        at = folded.find(term, at + len(term))
    if whole_words and token_borders and out:
        edges = [m.span() for m in _TOKEN.finditer(text)]
        starts, ends = {a for a, _ in edges}, {b for _, b in edges}
        out = [(a, b) for a, b in out if a in starts and b in ends]
    return out


def spans_of(text: Column, term: str, *, case_sensitive: bool = False, whole_words: bool = False, token_borders: bool = False) -> Column:
    """array<struct<start, end>> of a term's occurrences."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def found(column: pd.Series) -> pd.Series:
        return column.map(lambda t: [{"start": a, "end": b} for a, b in literal_spans(t, term, case_sensitive, whole_words, token_borders)])

    return found(text)


def contains_term(text: Column, term: str, *, case_sensitive: bool = False, whole_words: bool = False) -> Column:
    """Whether a term occurs, without leaving the JVM."""
    if not whole_words:
        return text.contains(term) if case_sensitive else casefold(text).contains(term.casefold())
    quoted = r"\Q" + (term if case_sensitive else term.casefold()).replace(r"\E", r"\E\\E\Q") + r"\E"
    return (text if case_sensitive else casefold(text)).rlike(rf"(?<!\p{{L}}){quoted}(?!\p{{L}})")


def highlight_fragments(text: str, terms: list[str], case_sensitive: bool = False) -> list[dict]:
    """A text cut into matched and other pieces: earliest first, of one start the longest."""
    spans = sorted({s for t in terms for s in literal_spans(text, t, case_sensitive, False)}, key=lambda s: (s[0], -s[1]))
    out, at = [], 0
    for start, end in spans:
        if start < at:
            continue
        if start > at:
            out.append({"text": text[at:start], "matched": False})
        out.append({"text": text[start:end], "matched": True})
        at = end
    return out + ([{"text": text[at:], "matched": False}] if at < len(text) else [])


def highlighted(text: Column, terms: list[str], case_sensitive: bool = False) -> Column:
    @F.pandas_udf("array<struct<text:string,matched:boolean>>")
    def cut(column: pd.Series) -> pd.Series:
        return column.map(lambda t: highlight_fragments(t or "", terms, case_sensitive))

    return cut(text)
