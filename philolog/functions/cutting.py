"""Texts cut into tokens in Arrow batches: sentences and tokens as text.sentences() and text.tokens() find them.

Folding and marks are worked out once for each distinct surface of some documents. Classes of
characters are those of Python's Unicode tables.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed: ends of sentences; closing quotes after the stop go with the blank.
SENTENCE_END = "(?<=[.!?])[\"'”’)]* "
SENTENCE_END_ZH = "(?<=[。！？!?])"
_END, _END_ZH = re.compile(SENTENCE_END), re.compile(SENTENCE_END_ZH)
#: Letters of texts that are cut at once.
LETTERS_AT_ONCE = 4_000_000
_PLANE = 0x10000


@cache
def _ranges(kind: str, high: int) -> str:
    """Characters of a general category as the inside of a class."""
    at = np.array([i for i in range(high) if unicodedata.category(chr(i))[0] == kind])
    breaks = np.flatnonzero(np.diff(at) > 1)
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(at[[0, *(breaks + 1)]], at[[*breaks, -1]], strict=True))


SPACES = "\t\n\v\f\r \x85" + "".join(c for c in map(chr, range(0x80, _PLANE)) if unicodedata.category(c)[0] == "Z")
_TURNED = [c for c in SPACES if c != " "]


@cache
def _pattern(high: int) -> re.Pattern:
    """text.TOKEN for texts without characters from `high` on: beyond the first plane, classes are searched one range after the other."""
    letters, numbers = _ranges("L", high), _ranges("N", high)
    return re.compile(rf"[{letters}]+(?:['’\-][{letters}]+)*|[{numbers}]+(?:[.,][{numbers}]+)*|[^{letters}{numbers}{re.escape(SPACES)}]")


def finder(text: str) -> Callable[[str], list[str]]:
    """What finds the tokens of a text and of its parts."""
    return _pattern(0x80 if text.isascii() else _PLANE if len(text.encode("utf-16-le")) == 2 * len(text) else sys.maxunicode + 1).findall


def sentences(text: str, language: str | None) -> list[str]:
    for c in _TURNED[:5] if text.isascii() else _TURNED:
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    parts = (_END_ZH if language == "zh" else _END).split(text.strip(" "))
    return [s for p in parts if (s := p.strip(" "))]


def is_punctuation(token: str) -> bool:
    """Whether a token is a mark: those of more than one character are words or numbers."""
    return len(token) == 1 and unicodedata.category(token)[0] in "PS"


class Cut:
    """Some documents: their sentences (rows: document, language, number, length) and the surfaces of all, as indices of distinct ones."""

    def __init__(self, texts: list[bytes | None], languages: list[str | None]):
        flat, lines, counts, per = [], [], [], []
        for raw, language in zip(texts, languages, strict=True):
            found = sentences(raw.decode("utf-8", "replace"), language) if raw else []
            find = finder("".join(found)) if found else None
            for s in found:
                own = find(s)
                counts.append(len(own))
                flat += own
            lines += found
            per.append(len(found))
        self.lines, self.per = lines, np.array(per, np.int64)
        self.counts = np.array(counts, np.int64)
        self.upto = np.append(0, np.cumsum(self.counts))  # tokens before each sentence, and all
        self.first = np.append(0, np.cumsum(self.per))  # sentences before each document, and all
        self.sizes = np.diff(self.upto[self.first])  # tokens of each document
        coded = pa.array(flat, pa.string()).dictionary_encode()
        self.distinct, self.index = coded.dictionary, coded.indices.to_numpy()
        known = self.distinct.to_pylist()
        self.folded, self.marks = [t.casefold() for t in known], [is_punctuation(t) for t in known]

    def surfaces(self) -> pa.Array:
        return self.distinct.take(pa.array(self.index))

    def words(self) -> pa.Array:
        return pa.array(self.folded, pa.string()).take(pa.array(self.index))

    def punctuation(self) -> pa.Array:
        return pa.array(self.marks, pa.bool_()).take(pa.array(self.index))


def lists(values: pa.Array, upto: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values)


def _before(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the lengths before each entry within its group; groups begin at `first`."""
    sums = np.append(0, np.cumsum(lengths))
    return sums[:-1] - np.repeat(sums[first[:-1]], np.diff(first))


def document_rows(cut: Cut, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    ends = cut.upto[cut.first]
    before = pa.array(_before(cut.counts, cut.first), pa.int64())
    return {"document_id": batch.column("document_id"), "language": batch.column("language"), "surfaces": lists(cut.surfaces(), ends), "words": lists(cut.words(), ends), "before": lists(before, cut.first)}


def sentence_rows(cut: Cut, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    row = pa.array(np.repeat(np.arange(len(cut.per)), cut.per))
    number = np.arange(len(cut.counts)) - np.repeat(cut.first[:-1], cut.per) + 1
    lengths = np.array([len(s) + 1 for s in cut.lines], np.int64)
    return {
        "document_id": batch.column("document_id").take(row), "language": batch.column("language").take(row), "sentence_no": pa.array(number, pa.int64()), "sentence": pa.array(cut.lines, pa.string()),
        "tokens": lists(cut.surfaces(), cut.upto), "words": lists(cut.words(), cut.upto), "marks": lists(cut.punctuation(), cut.upto), "tokens_before": pa.array(_before(cut.counts, cut.first), pa.int64()),
        "document_length": pa.array(np.repeat(cut.sizes, cut.per), pa.int64()), "stream_start": pa.array(_before(lengths, cut.first), pa.int64()),
    }


def token_rows(cut: Cut, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    line = np.repeat(np.arange(len(cut.counts)), cut.counts)
    document = np.repeat(np.arange(len(cut.per)), cut.per)
    row = pa.array(document[line])
    number = np.arange(len(cut.counts)) - np.repeat(cut.first[:-1], cut.per) + 1
    at = np.arange(len(line))
    return {
        "document_id": batch.column("document_id").take(row), "language": batch.column("language").take(row), "sentence_no": pa.array(number[line], pa.int64()), "sentence_position": pa.array(at - cut.upto[:-1][line] + 1, pa.int64()),
        "stream_position": pa.array(at - np.repeat(cut.upto[cut.first[:-1]], cut.sizes) + 1, pa.int64()), "surface": cut.surfaces(), "normalized": cut.words(), "is_punctuation": cut.punctuation(),
        "sentence_length": pa.array(cut.counts[line], pa.int64()), "document_length": pa.array(np.repeat(cut.sizes, cut.sizes), pa.int64()),
    }


def _grouped(cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Tokens by document and folded word, then by position; where each group starts; each token's document and word; the words."""
    folded = pa.array(cut.folded, pa.string()).dictionary_encode()
    own = folded.indices.to_numpy().astype(np.int64)[cut.index] if len(cut.index) else np.zeros(0, np.int64)
    document = np.repeat(np.arange(len(cut.per)), cut.sizes)
    key = document * max(len(folded.dictionary), 1) + own
    order = np.argsort(key, kind="stable")
    return order, np.flatnonzero(np.diff(key[order], prepend=-1)), document, own, folded


def _by_bytes(cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """Distinct surfaces in the order of their bytes, and each one's place in it."""
    order = pc.sort_indices(cut.distinct.cast("binary")).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place


def _least(cut: Cut, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least surface of each group, by bytes."""
    by_bytes, place = _by_bytes(cut)
    return by_bytes[np.minimum.reduceat(place[cut.index[order]], starts)] if len(starts) else np.zeros(0, np.int64)


def term_rows(cut: Cut, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """A row for each folded word of a document; display: the least of its surfaces by bytes, first: the first one, at position `at`. Folding keeps what is punctuation."""
    order, starts, document, own, folded = _grouped(cut)
    first = order[starts]
    row, at = pa.array(document[first]), first - np.repeat(cut.upto[cut.first[:-1]], cut.sizes)[first] + 1
    return {
        "document_id": batch.column("document_id").take(row), "language": batch.column("language").take(row), "normalized": folded.dictionary.take(pa.array(own[first])), "n": pa.array(np.diff(np.append(starts, len(order))), pa.int64()),
        "display": cut.distinct.take(pa.array(_least(cut, order, starts))), "first": cut.distinct.take(pa.array(cut.index[first])), "at": pa.array(at, pa.int64()), "is_punctuation": pa.array(cut.marks, pa.bool_()).take(pa.array(cut.index[first])),
    }


def posting_rows(cut: Cut, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """A row for each folded word of all these documents: how often and in how many it stands, the least surface and all, the documents and its positions (from 1) in each."""
    order, starts, document, own, folded = _grouped(cut)
    ends, first = np.append(starts[1:], len(order))[: len(starts)], order[starts]
    # groups are by document, then by word; here a word's documents come together
    by_word = np.argsort(own[first], kind="stable")
    word = own[first][by_word]
    head = np.flatnonzero(np.diff(word, prepend=-1))
    upto = np.append(head, len(word))
    lengths = (ends - starts)[by_word]
    inner = np.append(0, np.cumsum(lengths))
    places = np.repeat(starts[by_word] - inner[:-1], lengths) + np.arange(inner[-1])
    token = order[places]
    at = token - np.repeat(cut.upto[cut.first[:-1]], cut.sizes)[token] + 1
    by_bytes = _by_bytes(cut)
    kept = np.unique(own[token] * max(len(cut.distinct), 1) + by_bytes[1][cut.index[token]])
    which, surface = kept // max(len(cut.distinct), 1), by_bytes[0][kept % max(len(cut.distinct), 1)]
    begins = np.flatnonzero(np.diff(which, prepend=-1))  # words come in the order of their codes, as in `word`
    shown = surface[begins]
    documents = pa.array(document[first][by_word])
    return {
        "language": batch.column("language").take(documents.take(pa.array(head))), "term": folded.dictionary.take(pa.array(word[head])), "frequency": pa.array(np.diff(inner[upto]), pa.int64()), "document_range": pa.array(np.diff(upto), pa.int64()),
        "display": cut.distinct.take(pa.array(shown)), "is_punctuation": pa.array(cut.marks, pa.bool_()).take(pa.array(shown)), "surfaces": lists(cut.distinct.take(pa.array(surface)), np.append(begins, len(which))),
        "document_ids": lists(batch.column("document_id").take(documents), upto), "positions": lists(lists(pa.array(at, pa.int32()), inner), upto),
    }


ROWS = {
    "document": (document_rows, "document_id {id}, language string, surfaces array<string>, words array<string>, before array<long>"),
    "sentence": (sentence_rows, "document_id {id}, language string, sentence_no long, sentence string, tokens array<string>, words array<string>, marks array<boolean>, tokens_before long, document_length long, stream_start long"),
    "token": (token_rows, "document_id {id}, language string, sentence_no long, sentence_position long, stream_position long, surface string, normalized string, is_punctuation boolean, sentence_length long, document_length long"),
    "term": (term_rows, "document_id {id}, language string, normalized string, n long, display string, first string, at long, is_punctuation boolean"),
    "posting": (posting_rows, "language string, term string, frequency long, document_range long, display string, is_punctuation boolean, surfaces array<string>, document_ids array<{id}>, positions array<array<int>>"),
}


def cutter(kind: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over document_id, language, text: these columns of rows of a kind, some documents at a time."""
    made = ROWS[kind][0]

    def parted(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if kind != "posting":
            return iter([part])
        # documents that share a row have one language
        return (part.filter(pc.equal(part.column("language"), x) if x.is_valid else pc.is_null(part.column("language"))) for x in pc.unique(part.column("language")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = np.flatnonzero(np.diff(np.cumsum(sizes) // LETTERS_AT_ONCE, prepend=0))
            for low, high in zip([0, *marks], [*marks, len(batch)], strict=True):
                if high > low:
                    for part in parted(batch.slice(low, high - low)):
                        rows = made(Cut(part.column("text").cast("binary").to_pylist(), part.column("language").to_pylist()), part)
                        yield pa.RecordBatch.from_arrays([rows[n] for n in names], names=names)

    return run
