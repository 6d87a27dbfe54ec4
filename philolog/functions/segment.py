"""Words of Han text, which has no blanks: the most probable path through a lattice of known words.

The lexicon is learned from words that a tagged corpus gives. A stretch of Han text is cut so that the
product of its words' shares is greatest; a character that no word of the lexicon covers is a word of
its own, so a text without any known word is cut into characters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from philolog.functions import text as X
from philolog.plans.query import Slot, parse_simple

#: Most words of a lexicon, of which none is longer than MOST_LETTERS: a bound on what workers hold.
LEXICON, MOST_LETTERS = 1 << 18, 16
_HAN = r"\p{Script=Han}"
_PIECE = regex.compile(rf"{_HAN}+|[^{_HAN}]+")
_TOKEN = regex.compile(X.TOKEN)
#: A token where no lexicon is at hand: a Han character, or what TOKEN takes without any.
BY_CHARACTER = rf"\p{{IsHan}}|[\p{{L}}&&[^\p{{IsHan}}]]+(?:['’\-][\p{{L}}&&[^\p{{IsHan}}]]+)*|\p{{N}}+(?:[.,]\p{{N}}+)*|[^\p{{L}}\p{{N}}\s\u0085\p{{Z}}]"


def characters(text: Column) -> Column:
    """Tokens of a text in which each Han character is one: built-in functions only."""
    return F.regexp_extract_all(text, F.lit(BY_CHARACTER), F.lit(0))


@dataclass(frozen=True)
class Lexicon:
    """Words with the logarithms of their shares, and that of a character that no word covers."""

    logs: dict[str, float]
    unknown: float = -30.0
    longest: int = field(default=1)

    def cut(self, run: str) -> list[str]:
        """The most probable words of a run of Han letters; of equal paths the one whose last words are longest. Time rises with the run's length, space too."""
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            score, start = best[end - 1] + self.logs.get(run[end - 1], self.unknown), end - 1
            for at in range(end - 2, max(-1, end - self.longest - 1), -1):
                log = self.logs.get(run[at:end])
                if log is not None and best[at] + log >= score:
                    score, start = best[at] + log, at
            best.append(score)
            back.append(start)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """Tokens of a text, Han runs cut."""
        out = []
        for token in _TOKEN.findall(text):
            if not regex.search(_HAN, token):
                out.append(token)
                continue
            for piece in _PIECE.findall(token):
                out += self.cut(piece) if regex.match(_HAN, piece) else _TOKEN.findall(piece)
        return out

    def tokens(self, text: Column) -> Column:
        """array<string>: words() of a column; null of a null."""
        known = self

        @F.pandas_udf("array<string>")
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else known.words(t))

        return cut(text)

    def tokens_of_each(self, texts: Column) -> Column:
        """array<array<string>>: words() of each entry; null of a null."""
        known = self

        @F.pandas_udf("array<array<string>>")
        def cut(rows: pd.Series) -> pd.Series:
            return rows.map(lambda r: None if r is None else [known.words(t) for t in r])

        return cut(texts)


def learn(words: DataFrame, column: str = "surface", *, most: int = LEXICON) -> Lexicon:
    """A lexicon of the Han words of a column of single words, such as a tagged corpus's tokens.

    All of them are counted. Words that make up 1 / most of them are kept, so at most `most`.
    """
    han = words.select(F.col(column).alias("word")).where(F.col("word").rlike(r"^\p{IsHan}+$") & (F.length("word") <= MOST_LETTERS))
    counts = han.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = {r["word"]: math.log(r["n"] / total) for r in counts.where(F.col("n") * most >= total).collect()}
    return Lexicon(kept, math.log(0.01 / max(total, 1)) if total else -30.0, max(map(len, kept), default=1))


def resolved(query: str, lexicon: Lexicon | None, found, *, language: str = "zh", whole_words: bool = True, case_sensitive: bool = False, regular: bool = False) -> list[Slot]:
    """Slots of a query; a Chinese term is sought as one token first, and cut only if that finds nothing.

    found(slots) tells whether there is a hit: a probe for a single row. Queries with blanks, wildcards
    or patterns, and those that aren't of whole words, are read as they stand.
    """
    plain = parse_simple(query, whole_words=whole_words, case_sensitive=case_sensitive, regular=regular)
    if language != "zh" or regular or not whole_words or regex.search(r"\s", query) or any(c in query for c in "*?|["):
        return plain
    value = lambda w: w if case_sensitive else w.casefold()
    parts = lexicon.words(query) if lexicon else regex.findall(rf"{_HAN}|[^{_HAN}]+", query)
    cut = [Slot("exact", value(w), case_sensitive=case_sensitive) for w in parts]
    whole = [Slot("exact", value(query), case_sensitive=case_sensitive)]
    return cut if whole == cut or not cut else whole if found(whole) else cut
