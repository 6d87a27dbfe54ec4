"""Two query languages, their common form, and its translation into column predicates.

The simple language: blank-separated terms with * ? | and [a,b] wildcards, or regular expressions per
token. The bracket language: "phrase", [word|lemma|pos="v"], [], starts_with(v), ends_with(v),
contains(v), and bare terms with wildcards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import regex
from pyspark.errors import PythonException
from pyspark.sql import Column
from pyspark.sql import functions as F

from philolog.functions import text as X

#: Fixed limits: characters of a query, its tokens, characters of one value and of a pattern.
MAX_QUERY, MAX_TOKENS, MAX_VALUE, MAX_PATTERN = 500, 20, 100, 200
_TOKEN = regex.compile(X.TOKEN)
_RESERVED = '"[]();'


class QueryError(ValueError):
    """A query that cannot be understood; `position` counts from 1, 0 if there is none."""

    def __init__(self, message: str, position: int = 0):
        super().__init__(f"{message} (position {position})" if position else message)
        self.position = position


class PatternTimeout(QueryError):
    """A pattern took too long on one text."""


@contextmanager
def pattern_errors() -> Iterator[None]:
    """Around an action: a pattern that ran out of time on a worker ends in a PatternTimeout here."""
    try:
        yield
    except PythonException as problem:
        if found := re.search(r"PatternTimeout: (.+)", str(problem)):
            raise PatternTimeout(found[1]) from problem
        raise


@dataclass(frozen=True)
class Slot:
    """What one token must be. kind: any, exact, contains, starts, ends, wildcard, regex (part) or full (whole)."""

    kind: str
    value: str = ""
    attribute: str = "word"
    case_sensitive: bool = False

    @property
    def open(self) -> bool:
        return self.kind == "any"


def split_terms(value: str) -> list[str]:
    return _TOKEN.findall(value)


def detect_language(query: str) -> str:
    return "zh" if re.search("[一-鿿]", query) else "en"


def check_pattern(pattern: str, most: int = MAX_PATTERN) -> str:
    if len(pattern) > most:
        raise QueryError(f"pattern of more than {most} characters")
    try:
        regex.compile(pattern)
    except regex.error as problem:
        raise QueryError(f"pattern does not compile: {problem}") from None
    return pattern


def quoted(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def wildcard_pattern(term: str) -> str:
    if term.startswith("[") and term.endswith("]") and "," in term:
        options = [quoted(x.strip()) for x in term[1:-1].split(",") if x.strip()]
        if not options:
            raise QueryError("empty list of options")
        return f"(?:{'|'.join(options)})"
    if "|" in term:
        options = [x for x in term.split("|") if x]
        if len(options) < 2:
            raise QueryError("alternatives need two sides")
        return f"(?:{'|'.join(map(wildcard_pattern, options))})"
    if not term.strip("*?"):
        raise QueryError("a wildcard needs a plain character beside it")
    return "".join({"*": ".*", "?": "."}.get(c) or quoted(c) for c in term)


def _is_wild(term: str) -> bool:
    return any(c in term for c in "*?|") or (term.startswith("[") and term.endswith("]") and "," in term)


def parse_simple(query: str, *, whole_words: bool = True, case_sensitive: bool = False, regular: bool = False) -> list[Slot]:
    if len(query) > MAX_QUERY:
        raise QueryError(f"query of more than {MAX_QUERY} characters")
    if regular:
        slots = [Slot("full" if whole_words else "regex", check_pattern(t), case_sensitive=case_sensitive) for t in query.split()]
    elif _is_wild(query):
        slots = []
        for term in query.split():
            if _is_wild(term):
                slots.append(Slot("full" if whole_words else "regex", check_pattern(wildcard_pattern(term)), case_sensitive=case_sensitive))
            else:
                slots.append(_plain(term, whole_words, case_sensitive))
    else:
        slots = [_plain(t, whole_words, case_sensitive) for t in split_terms(query)]
    return _checked(slots)


def _plain(term: str, whole_words: bool, case_sensitive: bool) -> Slot:
    return Slot("exact" if whole_words else "contains", term if case_sensitive else term.casefold(), case_sensitive=case_sensitive)


def _checked(slots: list[Slot]) -> list[Slot]:
    if not slots:
        raise QueryError("nothing to search for")
    if len(slots) > MAX_TOKENS:
        raise QueryError(f"more than {MAX_TOKENS} tokens")
    return slots


_ITEM = re.compile(
    r"""\s*(?:"(?P<phrase>[^"]*)"|(?P<open>\[\s*\])|\[\s*(?P<attribute>word|lemma|pos)\s*=\s*"(?P<value>[^"]*)"\s*\]"""
    r"""|(?P<call>starts_with|ends_with|contains)\(\s*(?:"(?P<argument>[^"]*)"|(?P<raw>[^"()]*))\s*\)|(?P<bare>[^\s"\[\]()]+))(?=\s|$)""",
    re.IGNORECASE,
)


def parse_brackets(query: str) -> list[Slot]:
    source = " ".join(query.split())
    if not source:
        raise QueryError("empty query")
    if len(source) > MAX_QUERY:
        raise QueryError(f"query of more than {MAX_QUERY} characters")
    slots, at = [], 0
    while at < len(source):
        item = _ITEM.match(source, at)
        if not item:
            raise QueryError("unclosed or misplaced mark", at + 1)
        at = item.end()
        if item["phrase"] is not None:
            words = split_terms(_value(item["phrase"]))
            if not words:
                raise QueryError("empty phrase", item.start() + 1)
            slots += [Slot("exact", w.casefold()) for w in words]
        elif item["open"]:
            slots.append(Slot("any"))
        elif item["attribute"]:
            value = _value(item["value"].strip(), wild=True)
            attribute = item["attribute"].lower()
            slots.append(Slot("wildcard" if "*" in value or "?" in value else "exact", value if attribute == "pos" else value.casefold(), attribute))
        elif item["call"]:
            value = _value((item["argument"] if item["argument"] is not None else item["raw"]).strip())
            slots.append(Slot({"starts_with": "starts", "ends_with": "ends", "contains": "contains"}[item["call"].lower()], value.casefold()))
        elif "*" in item["bare"] or "?" in item["bare"]:
            slots.append(Slot("wildcard", _value(item["bare"], wild=True).casefold()))
        else:
            slots += [Slot("exact", w.casefold()) for w in split_terms(_value(item["bare"]))]
    return _checked(slots)


def _value(value: str, wild: bool = False) -> str:
    if not value.strip():
        raise QueryError("empty value")
    if len(value) > MAX_VALUE:
        raise QueryError(f"value of more than {MAX_VALUE} characters")
    for c in value:
        if ord(c) < 32 or c in _RESERVED or (not wild and c in "*?"):
            raise QueryError(f"value holds {c!r}")
    if wild and not value.strip("*?"):
        raise QueryError("a wildcard needs a plain character beside it")
    return value


def _like(value: str) -> str:
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def of_token_row(slot: Slot, name: str) -> Column:
    return F.col(name)


def predicate(slot: Slot, language: str = "en", value: Callable[[Slot, str], Column] = of_token_row) -> Column:
    """The slot as a condition on a token; `value` gives the token's surface, normalized, lemma or pos."""
    word = value(slot, "surface" if slot.case_sensitive else "normalized")
    if slot.attribute == "pos":
        word = value(slot, "pos")
    elif slot.attribute == "lemma":
        word = F.coalesce(F.nullif(value(slot, "lemma"), F.lit("")), value(slot, "normalized"))
        word = F.lower(word) if language == "en" else word
    if slot.kind == "any":
        return F.lit(True)
    if slot.kind == "exact":
        return word == slot.value
    if slot.kind == "contains":
        return word.contains(slot.value)
    if slot.kind == "starts":
        return word.startswith(slot.value)
    if slot.kind == "ends":
        return word.endswith(slot.value)
    if slot.kind == "wildcard":
        pattern = _like(slot.value).replace("*", "%").replace("?", "_")
        return word.ilike(pattern) if slot.attribute == "pos" else word.like(pattern)
    flags = "" if slot.case_sensitive else "(?iu)"
    return value(slot, "surface").rlike(f"{flags}^(?:{slot.value})$" if slot.kind == "full" else f"{flags}{slot.value}")


def may_hold(documents_text: Column, slots: list[Slot]) -> Column:
    """A condition on whole texts that every text with a hit meets; keeps the others from being cut into tokens."""
    out = F.lit(True)
    folded = X.casefold(documents_text)
    for slot in slots:
        if slot.attribute == "word" and slot.kind in ("exact", "contains", "starts", "ends") and slot.value:
            out = out & (documents_text.contains(slot.value) if slot.case_sensitive else folded.contains(slot.value))
    return out
