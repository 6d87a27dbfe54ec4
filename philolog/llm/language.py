"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. A word that it does not
know falls back to its character n-grams, the longest length first: the first length of which the
model knows any gives the word's score, the mean log frequency of those n-grams. A text's score for a
language is the sum over its words.

The model is fitted on a bounded sample of labelled rows (ROWS_PER_LANGUAGE, chosen by a hash of the
id) and holds every word and n-gram of that sample, each as a 64-bit hash. Fitting and prediction cut
words by the same function.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from philolog.llm import _bytes

#: Labelled rows of each language that the model is fitted on, about.
ROWS_PER_LANGUAGE = 4000
#: Lengths of character n-grams, the longest first; a word is fenced with spaces.
LENGTHS = (4, 3, 2, 1)
#: Of each language's frequency mass, what unknown entries have.
UNSEEN = 1e-6
BATCH_BYTES = 2 << 20
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    fenced = f" {word} "
    return [fenced[i : i + n] for i in range(len(fenced) - n + 1)] if n > 1 else list(word)


def name_of(length: int, entry: str) -> int:
    """Name of an n-gram, or of a whole word (length 0)."""
    return xxhash.xxh64_intdigest(entry, seed=length)


def word_blocks(column: pa.Array):
    """(first row, last row, row of each word, place of each word among the distinct ones, distinct words) of blocks of texts.

    A word is a run of letters, in lower case. Null counts as empty.
    """
    texts = pc.fill_null(column, "")
    _, offsets = _bytes.utf8(texts)
    for lo, hi in _bytes.blocks(offsets, BATCH_BYTES):
        part = pc.replace_substring_regex(pc.utf8_lower(texts.slice(lo, hi - lo).cast(pa.large_string())), r"\P{L}+", " ")
        cut = pc.split_pattern(part, " ")
        row = np.repeat(np.arange(hi - lo), np.diff(cut.offsets.to_numpy()))
        coded = cut.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        real = np.array([bool(w) for w in words], bool)[index] if words else np.zeros(0, bool)
        yield lo, hi, row[real], index[real], words


def _count(batches):
    """Rows (lang, length, name, n); length 0: whole words."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, _, row, index, words in word_blocks(batch.column(1)):
            pairs, times = np.unique(np.stack((row, index), 1), axis=0, return_counts=True)
            for (r, i), n in zip(pairs.tolist(), times.tolist(), strict=True):
                counts.setdefault(langs[lo + r], Counter())[words[i]] += n
    for lang, words in counts.items():
        tables = {0: words, **{n: Counter() for n in LENGTHS}}
        for word, times in words.items():
            for n in LENGTHS:
                for g in grams(word, n):
                    tables[n][g] += times
        for n, table in tables.items():
            names = np.array([name_of(n, e) for e in table], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table), pa.string()), pa.array([n] * len(table), pa.int32()), pa.array(names.view(np.int64)), pa.array(list(table.values()), pa.int64())], ["lang", "length", "name", "n"])


@dataclass
class Model:
    """Languages in order, and the log frequencies of entries in each of them; names are sorted."""

    languages: list[str]
    names: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, languages: list[str], rows: list[tuple[str, int, float]]) -> Model:
        """Of (language, name, share) rows: the share of the language's entries of that length."""
        return cls.of_columns(languages, np.array([languages.index(r[0]) for r in rows], int), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows], float))

    @classmethod
    def of_columns(cls, languages: list[str], language: np.ndarray, names: np.ndarray, shares: np.ndarray) -> Model:
        """The same of arrays, with languages by their places: nothing is held for each row but numbers."""
        names, at = np.unique(names, return_inverse=True)
        values = np.full((len(names), len(languages)), math.log(UNSEEN))
        values[at, language] = np.log(shares + UNSEEN)
        return cls(languages, names, values)

    def places(self, names: list[int]) -> np.ndarray:
        """Place of each name, -1 for one that isn't held."""
        wanted = np.array(names, np.uint64)
        if not len(self.names):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.names, wanted), len(self.names) - 1)
        return np.where(self.names[at] == wanted, at, -1)

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; zeros for one of which nothing is known."""
        out = np.zeros((len(words), len(self.languages)))
        at = self.places([name_of(0, w) for w in words])
        out[at >= 0] = self.values[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in LENGTHS:
            cut = [grams(words[i], n) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(c) for c in cut])
            at = self.places([name_of(n, g) for c in cut for g in c])
            owner, at = owner[at >= 0], at[at >= 0]
            found = np.bincount(owner, minlength=len(left))
            for k in range(len(self.languages)):
                sums = np.bincount(owner, self.values[at, k], len(left))
                out[left[found > 0], k] = sums[found > 0] / found[found > 0]
            left = left[found == 0]
        return out


def fit(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the rows for which `learn` is true and neither text nor language is null.

    Of a language with more than ROWS_PER_LANGUAGE rows about so many are drawn, row by row: by a hash
    of id, text and place in the input, so that ids may be null or repeated.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id()).alias("name"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model.of([], [])
    place = F.pmod(F.col("name"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 30, (ROWS_PER_LANGUAGE << 30) // n))])
    counted = rows.where(place < share[F.col("lang")]).select("lang", "text").mapInArrow(_count, "lang string, length int, name long, n long")
    counted = counted.groupBy("lang", "length", "name").agg(F.sum("n").alias("n"))
    # the sample bounds what comes to the driver: three numbers for each of its words and n-grams
    kept = counted.select("lang", "name", (F.col("n") / F.sum("n").over(Window.partitionBy("lang", "length"))).alias("share")).toArrow()
    coded = kept["lang"].combine_chunks().dictionary_encode()
    found = coded.dictionary.to_pylist()
    languages = sorted(found)
    place_of = np.array([languages.index(lang) for lang in found], int)
    return Model.of_columns(languages, place_of[coded.indices.to_numpy()], kept["name"].to_numpy().view(np.uint64), kept["share"].to_numpy())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs; score is the posterior of the prediction.

    A null text, one without letters, or a model without languages gives `und` and 0.0. Equal scores
    go to the language that comes first by code point. Ids may be null or repeated.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        languages, wide = np.array([*model.languages, UNKNOWN], object), len(model.languages)
        for batch in batches:
            for lo, hi, row, index, words in word_blocks(batch.column(1)):
                best, score = np.full(hi - lo, wide), np.zeros(hi - lo)
                if wide:
                    table = model.score(words)
                    sums = np.stack([np.bincount(row, table[index, k], hi - lo) for k in range(wide)], 1)
                    with np.errstate(under="ignore"):
                        odds = np.exp(sums - sums.max(1, keepdims=True))
                    lettered = np.bincount(row, minlength=hi - lo) > 0
                    best = np.where(lettered, sums.argmax(1), wide)
                    score = np.where(lettered, 1 / odds.sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(languages[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
