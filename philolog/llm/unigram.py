"""Token counts under a unigram model, by dynamic programming shared over a trie of words.

A word's segmentation is the one whose tokens have the greatest sum of log probabilities. The best sum
of a prefix is the greatest, over the tokens it may end in, of the best sum before that token and the
token's own; so a trie node needs the nodes above it only, and prefixes that words share are worked
out once. The terminal node of a word holds its count of tokens. The sorted distinct words are the
trie in preorder.

A vocabulary file gives tokens but no probabilities; the token of rank r (single bytes first, then in
the order of merging) has probability 1 / (r + 1) / H, with H the sum of 1 / (r + 1), which is Zipf's
law. Of equal sums the one with fewer tokens counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from philolog.llm import _bytes
from philolog.llm.bpe import BATCH_BYTES, Bpe, Encoder


def log_probabilities(n: int) -> list[float]:
    harmonic = math.fsum(1 / (r + 1) for r in range(n))
    return [-math.log(r + 1) - math.log(harmonic) for r in range(n)]


class Counter(Encoder):
    """Keeps (tokens, log probability) of words and chunks lately seen."""

    def __init__(self, bpe: Bpe):
        super().__init__(bpe)
        self.value = log_probabilities(len(bpe.rank_of))
        #: Every end of a token, with the log probability if it is a token itself, else None.
        self.ends = {end: self.value[rank] if rank >= 0 else None for end, rank in bpe.ends.items()}

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, tuple]]:
        ends, absent = self.ends.get, ()
        best, count = [0.0], [0]  # by depth, of the prefix
        before = b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, least, start = -math.inf, 0, end - 1
                while start >= 0 and (own := ends(word[start:end], absent)) is not absent:
                    if own is not None:
                        total = best[start] + own
                        if total > top or (total == top and count[start] + 1 < least):
                            top, least = total, count[start] + 1
                    start -= 1
                best.append(top)
                count.append(least)
            before = word
            yield word, (count[-1], best[-1])

    @staticmethod
    def joined(values: list[tuple]) -> tuple:
        return sum(n for n, _ in values), math.fsum(s for _, s in values)

    @staticmethod
    def added(token: int) -> tuple:
        return 1, 0.0

    def counts(self, texts: list[str]) -> Iterator[tuple[int, float]]:
        cut = [self.chunks(t) for t in texts]
        self.learn({c for own in cut for c in own})
        known = self.known.young
        for own in cut:
            values = [known[c] for c in own]
            yield sum(n for n, _ in values), math.fsum(s for _, s in values)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """A worker keeps one over its tasks."""
    return Counter(Bpe(path))


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_probability) for every row of docs.

    A null or empty text has no tokens and log probability 0; the text of an added token counts as one
    token of log probability 0. Ids may be null or repeated; other columns are not read.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_probability", pa.float64())]

    def run(batches):
        own = counter(vocabulary_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            _, offsets = _bytes.utf8(texts)
            for lo, hi in _bytes.blocks(offsets, BATCH_BYTES):
                if hi == lo + 1:
                    parts = [x for part in own.parts(texts[lo].as_py()) for x in own.counts([part])]
                    n, score = [sum(n for n, _ in parts)], [math.fsum(s for _, s in parts)]
                else:
                    n, score = zip(*own.counts(texts.slice(lo, hi - lo).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(score, pa.float64())], schema=pa.schema(fields))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, log_probability double")
