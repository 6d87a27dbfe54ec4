"""BPE encoding and decoding with a byte-level vocabulary file, by walks over a trie of words.

A prefix's encoding ends in exactly one token: the one that leaves a shorter prefix whose own last
token may stand before it. So each trie node needs its last token only, found from the nodes above
it; a depth-first walk does that once for every prefix that words share. The sorted distinct words
are that trie in preorder: what a word shares with the one before it is a stack already filled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from philolog.llm import _bytes
from philolog.llm._memory import give_back

#: Fixed: the way byte-level vocabularies of this kind cut text into pre-tokens.
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A pre-token never spans a space that stands before a visible character.
CHUNK = re.compile(r" (?=[^\s\x1c-\x1f])")
#: Words, and chunks, whose ids a worker keeps at least; pairs of tokens that it knows about.
KEPT_WORDS, KEPT_PAIRS = 60_000, 300_000
#: Bytes of text whose distinct chunks are encoded together, and characters of a long text that are encoded at once.
BATCH_BYTES, PART = 2 << 20, 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter by which such vocabulary files write each byte: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """A vocabulary: encodes pre-tokens, and keeps what it knows about token pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = {word: bytes(letters[c] for c in word) for word in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: raw[w] for w, i in ids.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.added.items()}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.text_of = {i: str(i) for i in self.bytes_of}
        # rank: single bytes first, then in the order of merging
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        singles = sorted(i for i in self.bytes_of if len(self.bytes_of[i]) == 1)
        self.id_of_rank = singles.copy()
        rank = {i: r for r, i in enumerate(singles)}
        self.parts = [(r, r) for r in range(len(singles))]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            whole = ids[a + b]
            if whole not in rank:
                rank[whole] = len(self.id_of_rank)
                self.id_of_rank.append(whole)
                self.parts.append((rank[ids[a]], rank[ids[b]]))
            self.merged.setdefault((rank[ids[a]], rank[ids[b]]), rank[whole])
        self.rank_of = {self.bytes_of[i]: r for i, r in rank.items()}
        self.may: dict[int, bool] = {}

    @cached_property
    def ends(self) -> dict[bytes, int]:
        """Every end of a token, with the token's rank if it is one itself, else -1."""
        return {t[k:]: -1 for t in self.rank_of for k in range(1, len(t))} | self.rank_of

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging would leave the border between these tokens: undo merges, latest first, and see if an earlier one joins them."""
        a, b, before = left, right, len(self.parts)
        while True:
            whole = self.merged.get((a, b))
            if whole is not None and whole < before:
                fits = False
                break
            fits = True
            # the side made last is undone; a single byte is its own part
            if a > b:
                before, a = (a, self.parts[a][1]) if self.parts[a][1] != a else (b + 1, a)
                if before == b + 1:
                    if self.parts[b][0] == b:
                        break
                    b = self.parts[b][0]
            else:
                if self.parts[b][0] != b:
                    before, b = b + 1, self.parts[b][0]
                elif self.parts[a][1] != a:
                    before, a = a, self.parts[a][1]
                else:
                    break
        if len(self.may) > KEPT_PAIRS:
            self.may.clear()
        self.may[left << 32 | right] = fits
        return fits

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Ids of each word, for distinct words in sorted order."""
        ends, may, ids = self.ends.get, self.may, self.id_of_rank
        last, width = [-1], [0]  # by depth: rank and length of the last token of the prefix
        before = b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], width[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                fits, start = [], end - 1
                while start >= 0 and (token := ends(word[start:end])) is not None:
                    if token >= 0:
                        fits.append((token, start))
                    start -= 1
                for token, start in reversed(fits):
                    if not start:
                        break
                    left = last[start]
                    fit = may.get(left << 32 | token)
                    if self.may_follow(left, token) if fit is None else fit:
                        break
                last.append(token)
                width.append(end - start)
            before, out, at = word, [], len(word)
            while at:
                out.append(ids[last[at]])
                at -= width[at]
            out.reverse()
            yield word, tuple(out)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Kept:
    """A bounded dictionary: entries not asked for while `size` others came in are dropped."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def room(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def missing(self, keys: set) -> list:
        """Keys not known; known ones become young."""
        young, old = self.young, self.old
        out = []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out


def pretokens(chunk: str) -> list[str]:
    word = chunk[1:] if chunk[0] == " " else chunk
    if word.isalpha():
        return [chunk]
    if word[:-1].isalpha() and word[-1] in ".,;:!?":
        return [chunk[:-1], chunk[-1]]
    return PRETOKEN.findall(chunk)


class Encoder:
    """Encodes whole texts; keeps the ids of words and chunks lately seen."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.cuttable = not any(CHUNK.search(x) for x in bpe.added)
        self.words, self.known = Kept(KEPT_WORDS), Kept(KEPT_WORDS)

    def learn(self, chunks: set[str]) -> None:
        """Puts all of these chunks among the young ones, by one walk over their unknown words."""
        self.known.room()
        self.words.room()
        new = self.known.missing(chunks)
        parts = list(map(pretokens, new))
        words = self.words.young
        walked = self.walk(w.encode() for w in sorted(self.words.missing(set(chain.from_iterable(parts)))))
        words |= {w.decode(): value for w, value in walked}
        known = self.known.young
        for chunk, own in zip(new, parts, strict=True):
            known[chunk] = words[own[0]] if len(own) == 1 else self.joined([words[w] for w in own])
        known |= {text: self.added(i) for text, i in self.bpe.added.items()}

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, tuple]]:
        return self.bpe.walk(words)

    @staticmethod
    def joined(values: list[tuple]) -> tuple:
        return tuple(chain.from_iterable(values))

    @staticmethod
    def added(token: int) -> tuple:
        return (token,)

    def chunks(self, text: str) -> list[str]:
        """Pieces that can be encoded apart; an added token's text is a piece of its own."""
        out = []
        for part in self.bpe.added_pattern.split(text) if self.bpe.added_pattern else [text]:
            if part in self.bpe.added:
                out.append(part)
            elif part:
                first, *rest = CHUNK.split(part)
                if first:
                    out.append(first)
                out += [" " + x for x in rest]
        return out

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts that can be encoded apart: cut where a chunk begins, unless an added token might lie there."""
        at = 0
        while len(text) - at > PART and self.cuttable and (found := CHUNK.search(text, at + PART)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        cut = [self.chunks(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        known = self.known.young
        for own in cut:
            yield list(chain.from_iterable(map(known.__getitem__, own)))


def digests(own: Encoder, parts: Iterable[list[int]], keep: tuple[str, ...]) -> tuple:
    """n_tokens, digests of the ids and of the decoded text, and what is kept, of a text whose parts have these ids."""
    text_of, n, lead = own.bpe.text_of, 0, ""
    of_ids, of_text, ids, decoded = hashlib.sha256(), hashlib.sha256(), [], []
    for part in parts:
        if part:
            of_ids.update((lead + ",".join(map(text_of.__getitem__, part))).encode())
            lead = ","
        text = own.bpe.decode(part)
        of_text.update(text.encode())
        n += len(part)
        if "ids" in keep:
            ids.append(np.array(part, np.int32))
        if "decoded" in keep:
            decoded.append(text)
    values = {"ids": np.concatenate(ids) if ids else None, "decoded": "".join(decoded)}
    return n, of_ids.hexdigest(), of_text.hexdigest(), *(values[k] for k in keep)


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", *, keep: tuple[str, ...] = ("ids", "decoded"), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, digests of the ids and of the text decoded from them, as named in keep `ids` and `decoded`, and the columns named in carry.

    The file at vocabulary_path is opened on the executors. A null text counts as empty (no ids). Ids
    of documents may be null or repeated; columns that are not carried are not read. A long text is
    encoded in parts; a run without any border between pre-tokens has to be taken whole.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [(k, pa.list_(pa.int32()) if k == "ids" else pa.string()) for k in keep]

    def run(batches):
        from philolog.llm import bpe_levels  # which builds on this module

        own = bpe_levels.walker(vocabulary_path)
        for batch in batches:
            data, offsets = _bytes.utf8(batch.column(0))
            for lo, hi in _bytes.blocks(offsets, bpe_levels.BLOCK_BYTES):
                found = bpe_levels.columns(own, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], keep)
                columns = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, (_, k) in zip(found, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), *columns], [*batch.schema.names[1:], *(k for k, _ in fields)])
        # later stages run in the same workers: they keep the vocabulary's arrays, not what few words needed
        own.__dict__.pop("one_by_one", None)
        give_back()

    source = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {'array<int>' if k == 'ids' else 'string'}" for k in keep)
    out = source.mapInArrow(run, f"{kinds}, {made}")
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep, *(F.col(f"_{k}").alias(c) for k, c in enumerate(carry)))
