"""The last-token walk over the trie of distinct words, one level of the trie at a time.

What `bpe.Bpe.walk` does for one prefix after another is done here in arrays for all prefixes of a
length: an automaton over the vocabulary gives the longest token that each may end in, shorter ones
follow from the token, and the first that may stand after the last token before it is the prefix's
last token. Texts are cut into pre-tokens in arrays too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex

from philolog.llm.bpe import CHUNK, Bpe, Encoder, digests

#: Bytes of text that are encoded together; a text or part without a border that is longer than WHOLE is not held in arrays.
BLOCK_BYTES, WHOLE = 4 << 20, 8 << 20
#: A space before a character that is surely visible, of which the first byte tells that: a long text is cut there.
BORDER = re.compile(rb" (?=[!-~\xc3-\xe0\xe4-\xf4])")
#: Longer words are walked one by one, as each of their levels would hold few of them. Words up to SHORT bytes go together, so that few levels serve most.
SHORT, LONG = 32, 256
#: Cells (words times levels) that are held at once; pairs of tokens that are known.
CELLS, KEPT_PAIRS = 4 << 20, 300_000
#: Classes of characters.
BLANK, LETTER, DIGIT, OTHER = range(4)


class Table:
    """Keys (not below 0) and their numbers in open addressing; -1 is the number of a key that is absent."""

    def __init__(self, bits: int):
        self.shift, self.mask, self.size = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots(keys)
        there, out = self.keys[at], self.values[at]
        other = np.flatnonzero(there != keys)
        out[other] = -1
        other = other[there[other] >= 0]
        while len(other):
            at[other] = next_at = (at[other] + 1) & self.mask
            there = self.keys[next_at]
            same = there == keys[other]
            out[other[same]] = self.values[next_at[same]]
            other = other[~same & (there >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and absent."""
        at, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several keys one gets the slot
            mine = self.keys[at[left]] == keys[left]
            self.values[at[left[mine]]] = values[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & self.mask
        self.size += len(keys)

    def clear(self) -> None:
        self.keys[:], self.values[:], self.size = -1, -1, 0


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point, as the pre-tokens' pattern knows it."""
    out, every = np.full(0x110000, OTHER, np.uint8), "".join(map(chr, range(0x110000)))
    for kind, pattern in ((BLANK, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    return out


def starts(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point. edge: by place and for the end, whether a text begins there.

    As `bpe.PRETOKEN` cuts: a run of one class, with a single space that stands before it; blanks
    before that space, or before the last blank of a run, apart; endings as in 's after a bare apostrophe.
    """
    n, kind = len(points), classes()[points]
    out = edge[:n].copy()
    out[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~edge[1:n]) + 1
    out[after - 1] = True
    out[after] = points[after - 1] != 0x20
    quote = np.flatnonzero((points == 0x27) & out)
    quote = quote[~edge[quote + 1]]
    one = quote[np.isin(points[quote + 1], list(map(ord, "stmd")))]
    two = quote[~edge[np.minimum(quote + 2, n)]]
    pair = points[two + 1] << np.uint32(8) | points[two + 2]
    two = two[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]
    for found, width in ((one, 2), (two, 3)):
        out[found + 1] = False
        end = found + width
        out[end[end < n]] = True
    return out


def binary(data: np.ndarray | pa.Buffer, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), data if isinstance(data, pa.Buffer) else pa.py_buffer(np.ascontiguousarray(data))])


def parts_of(column: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of an array of strings that begins at the start of its buffers, and its n + 1 offsets."""
    _, offsets, data = column.buffers()
    return data if data is not None else pa.py_buffer(b""), np.frombuffer(offsets, np.int32, len(column) + 1) if len(column) else np.zeros(1, np.int32)


class Encoded:
    """Some texts: ids of all tokens in order, and by text the offsets into them, the ids as digits with a comma after each, and the bytes decoded from them."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, digits: memoryview, digits_at: np.ndarray, decoded: memoryview, decoded_at: np.ndarray):
        self.ids, self.offsets = ids, offsets
        self._digits, self._digits_at, self._decoded, self._decoded_at = digits, digits_at.tolist(), decoded, decoded_at.tolist()

    def digits(self, k: int) -> memoryview:
        """Ids of text k, joined by commas."""
        lo, hi = self._digits_at[k], self._digits_at[k + 1]
        return self._digits[lo : max(lo, hi - 1)]

    def decoded(self, k: int) -> str:
        return str(self._decoded[self._decoded_at[k] : self._decoded_at[k + 1]], "utf-8", "replace")


class Walker:
    """A vocabulary in arrays, with what is known of pairs of tokens."""

    def __init__(self, path: str):
        self.path, own = path, Bpe(path)
        tokens = [own.bytes_of[i] for i in own.id_of_rank]
        self.width = np.array([len(t) for t in tokens], np.int32)
        self.singles = int((self.width == 1).sum())
        self.absent = sorted({*range(256)} - {t[0] for t in tokens[: self.singles]})
        self.left, self.right = np.array(own.parts, np.int32).T.copy()
        pairs = np.array([a << 32 | b for a, b in own.merged], np.int64)
        self.merged = Table(18)
        while self.merged.mask < 4 * len(pairs):
            self.merged = Table(self.merged.mask.bit_length() + 1)
        self.merged.add(pairs, np.array(list(own.merged.values()), np.int32))
        self.known = Table(20)
        self.added = {text.encode(): i for text, i in own.added.items()}
        self.added_pattern = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # by rank, added tokens after all others
        self.ids = np.array([*own.id_of_rank, *self.added.values()], np.int32)
        self.bytes_of = pa.array([*tokens, *self.added], pa.binary())
        self.digits_of = pa.array([b"%d," % i for i in self.ids.tolist()], pa.binary())
        self.cuttable = not any(CHUNK.search(x) for x in own.added)
        self.rank_of_added = {text: len(tokens) + k for k, text in enumerate(self.added)}
        self._automaton(tokens)

    def _automaton(self, tokens: list[bytes]) -> None:
        """States are the tokens' prefixes. longest: of a state, the longest token at its end; shorter: of a token, the next shorter one at its end."""
        edges: dict[int, int] = {}
        node_of = np.zeros(len(tokens), np.int64)
        for rank, token in enumerate(tokens):
            node = 0
            for byte in token:
                node = edges.setdefault(node << 8 | byte, len(edges) + 1)
            node_of[rank] = node
        keys = np.fromiter(edges, np.int64, len(edges))
        depth = [0]
        for parent in (keys >> 8).tolist():
            depth.append(depth[parent] + 1)
        bits = max(12, (4 * len(keys)).bit_length())
        self.edges = Table(bits)
        self.edges.add(keys, np.arange(1, len(keys) + 1, dtype=np.int32))
        self.fail = np.zeros(len(keys) + 1, np.int64)
        self.longest = np.full(len(keys) + 1, -1, np.int32)
        self.longest[node_of] = np.arange(len(tokens))
        order = np.argsort(np.array(depth), kind="stable")
        cuts = np.searchsorted(np.array(depth)[order], np.arange(1, max(depth) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            nodes = order[lo:hi]
            if depth[nodes[0]] > 1:
                self.fail[nodes] = self.step(self.fail[keys[nodes - 1] >> 8], keys[nodes - 1] & 255)
            none = nodes[self.longest[nodes] < 0]
            self.longest[none] = self.longest[self.fail[none]]
        self.shorter = self.longest[self.fail[node_of]]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's next states. Every byte that has a token leads on from the first state."""
        out = self.edges.get(state << 8 | byte)
        none = np.flatnonzero(out < 0)
        while len(none):
            state[none] = back = self.fail[state[none]]
            out[none] = got = self.edges.get(back << 8 | byte[none])
            none = none[got < 0]
        return out.astype(np.int64)

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As `Bpe.may_follow`, for pairs."""
        fits, left, right = np.ones(len(left), bool), left.copy(), right.copy()
        before, rest = np.full(len(left), len(self.left)), np.arange(len(left))
        while len(rest):
            whole = self.merged.get(left << 32 | right)
            joined = (whole >= 0) & (whole < before)
            fits[rest[joined]] = False
            on = ~joined & (np.maximum(left, right) >= self.singles)
            rest, left, right = rest[on], left[on], right[on]
            # the side made last is undone
            first = left > right
            before = np.where(first, left, right + 1)
            left, right = np.where(first, self.right[left], left).astype(np.int64), np.where(first, right, self.left[right]).astype(np.int64)
        return fits

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        known = self.known.get(keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            pairs, place = np.unique(keys[new], return_inverse=True)
            fits = self.may_follow(pairs >> 32, pairs & 0xFFFFFFFF)
            known[new] = fits[place]
            if self.known.size + len(pairs) > KEPT_PAIRS:
                self.known.clear()
            self.known.add(pairs[:KEPT_PAIRS], fits[:KEPT_PAIRS].astype(np.int32))
        return known == 1

    def _walk(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the tokens of each word, and the number of them by word; words are few enough to be held with all levels."""
        n, most = len(begin), int(length.max())
        places = np.arange(most)[:, None]
        letters = np.where(places < length, data[np.minimum(begin + places, len(data) - 1)], 0)
        # neighbours that share a prefix share its nodes; beyond eight bytes few do
        first = np.zeros(n, np.uint64)
        for d in range(min(8, most)):
            first |= letters[d].astype(np.uint64) << np.uint64(56 - 8 * d)
        order = np.argsort(first)
        letters, length = letters[:, order], length[order]
        last = np.zeros((most + 1, n), np.int32)  # by depth and word: the last token of the prefix
        state, every = np.zeros(n, np.int64), np.arange(n)
        fresh = np.zeros(n, bool)  # whether the prefix differs from that of the word before
        fresh[0] = True
        for d in range(most):
            fresh[1:] |= (letters[d, 1:] != letters[d, :-1]) | (length[:-1] <= d)
            nodes = np.flatnonzero(fresh & (length > d))
            reached = self.step(state[nodes], letters[d, nodes].astype(np.int64))
            token = self.longest[reached]
            open_ = np.flatnonzero(self.width[token] <= d)
            while len(open_):
                tried = token[open_]
                fits = self.follows(last[d + 1 - self.width[tried], nodes[open_]], tried) | (self.width[tried] == 1)
                open_ = open_[~fits]
                token[open_] = self.shorter[token[open_]]
            last[d + 1, nodes], state[nodes] = token, reached
            own = np.zeros(n, np.int64)
            own[nodes] = nodes
            own = np.maximum.accumulate(own)
            last[d + 1], state = last[d + 1, own], state[own]
        at, rest, found = length.astype(np.int64), every, []
        while len(rest):
            token = last[at[rest], rest]
            found.append((rest, token))
            at[rest] -= self.width[token]
            rest = rest[at[rest] > 0]
        count = np.zeros(n, np.int64)
        for k, (rest, _) in enumerate(found):
            count[rest] = k + 1
        mine = np.empty(n, np.int64)
        mine[order] = count
        end = np.cumsum(mine)
        ranks = np.empty(end[-1], np.int32)
        for k, (rest, token) in enumerate(found):
            ranks[end[order[rest]] - 1 - k] = token
        return ranks, mine

    @cached_property
    def one_by_one(self) -> Bpe:
        return Bpe(self.path)

    def tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the tokens of distinct words, and n + 1 offsets of the words into them."""
        buffer, at = parts_of(words)
        data, length = np.frombuffer(buffer, np.uint8), np.diff(at).astype(np.int64)
        begin, count, groups = at[:-1].astype(np.int64), np.zeros(len(words), np.int64), []
        added = set()
        if self.added:
            for text, rank in self.rank_of_added.items():
                for k in np.flatnonzero(length == len(text)).tolist():
                    if data[begin[k] : begin[k] + len(text)].tobytes() == text:
                        added.add(k)
                        groups.append((np.array([k]), np.array([rank], np.int32), np.array([1])))
        walked = np.ones(len(words), bool)
        walked[list(added)] = False
        for low, high in ((0, SHORT), (SHORT, LONG)):
            some = np.flatnonzero(walked & (length > low) & (length <= high))
            for lo in range(0, len(some), CELLS // (high + 1)):
                few = some[lo : lo + CELLS // (high + 1)]
                groups.append((few, *self._walk(data, begin[few], length[few])))
        long = {data[begin[k] : begin[k] + length[k]].tobytes(): k for k in np.flatnonzero(walked & (length > LONG)).tolist()}
        if long:
            rank_of_id = {i: r for r, i in enumerate(self.ids.tolist())}
            for word, ids in self.one_by_one.walk(sorted(long)):
                groups.append((np.array([long[word]]), np.array([rank_of_id[i] for i in ids], np.int32), np.array([len(ids)])))
        for few, _, n in groups:
            count[few] = n
        offsets = np.concatenate(([0], np.cumsum(count)))
        ranks = np.empty(offsets[-1], np.int32)
        for few, own, n in groups:
            ranks[np.repeat(offsets[few] - (np.cumsum(n) - n), n) + np.arange(len(own))] = own
        return ranks, offsets

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Encoded:
        """Texts data[offsets[k]:offsets[k+1]], of some MB in all; offsets[0] is 0."""
        raw = data.tobytes()
        if self.absent and np.isin(data, self.absent).any():
            raise ValueError(f"{self.path} has no token for some byte of a text")
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)  # of each code point among the bytes
        edges, inside = [offsets[offsets < len(data)]], []
        if self.added_pattern and self.added_pattern.search(raw):
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                inside += [found.span() for found in self.added_pattern.finditer(raw, lo, hi)]
            edges += [np.array([x for span in inside for x in span if x < len(data)], np.int64)]
        edge = np.zeros(len(points) + 1, bool)
        edge[np.searchsorted(place, np.concatenate(edges))] = True
        edge[-1] = True
        at = place[starts(points, edge)]
        if inside:
            low, high = np.array(inside).T
            k = np.searchsorted(low, at, "right") - 1
            at = at[(k < 0) | (at == low[k]) | (at >= high[k])]
        words = binary(data, np.concatenate((at, [len(data)]))).dictionary_encode()
        ranks, word_at = self.tokens(words.dictionary)
        which = words.indices.to_numpy()
        text_at = np.searchsorted(at, offsets)

        def joined(of: pa.Array) -> tuple[memoryview, np.ndarray]:
            buffer, ends = parts_of(of.take(pa.array(ranks)))
            buffer, ends = parts_of(binary(buffer, ends[word_at]).take(words.indices))
            return memoryview(buffer), ends[text_at]

        count = np.diff(word_at)[which]
        ends = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[ranks][np.repeat(word_at[which] - ends[:-1], count) + np.arange(ends[-1])]
        return Encoded(ids, ends[text_at], *joined(self.digits_of), *joined(self.bytes_of))


@lru_cache(maxsize=1)
def walker(path: str) -> Walker:
    """A worker keeps one over its tasks: arrays of some 30 MB."""
    return Walker(path)


def parts(own: Walker, raw: bytes) -> Iterator[bytes]:
    """A long text in parts that can be encoded apart."""
    at = 0
    while len(raw) - at > BLOCK_BYTES and own.cuttable and (found := BORDER.search(raw, at + BLOCK_BYTES)):
        yield raw[at : found.start()]
        at = found.start()
    yield raw[at:] if at else raw


def long_text(own: Walker, raw: bytes, keep: tuple[str, ...]) -> tuple:
    """A text's n_tokens, digests and what is kept, part by part."""
    cut = list(parts(own, raw))
    if max(map(len, cut)) > WHOLE:
        plain = Encoder(own.one_by_one)
        return digests(plain, (ids for part in plain.parts(raw.decode()) for ids in plain.encode([part])), keep)
    n, of_ids, of_text, ids, decoded = 0, hashlib.sha256(), hashlib.sha256(), [], []
    for part in cut:
        found = own.encode(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
        if n:
            of_ids.update(b",")
        of_ids.update(found.digits(0))
        text = found.decoded(0)
        of_text.update(text.encode())
        n += len(found.ids)
        ids += [found.ids] * ("ids" in keep)
        decoded += [text] * ("decoded" in keep)
    values = {"ids": np.concatenate(ids) if ids else None, "decoded": "".join(decoded)}
    return n, of_ids.hexdigest(), of_text.hexdigest(), *(values[k] for k in keep)


def columns(own: Walker, data: np.ndarray, offsets: np.ndarray, keep: tuple[str, ...]) -> list:
    """n_tokens, digests and what is kept, of some texts; a text beyond BLOCK_BYTES stands alone."""
    n = len(offsets) - 1
    if len(data) > BLOCK_BYTES:
        return [[value] for value in long_text(own, data.tobytes(), keep)]
    found = own.encode(data, offsets)
    texts = [found.decoded(k) for k in range(n)]
    kept = {"ids": lambda: pa.ListArray.from_arrays(pa.array(found.offsets, pa.int32()), pa.array(found.ids)), "decoded": lambda: texts}
    return [np.diff(found.offsets), [hashlib.sha256(found.digits(k)).hexdigest() for k in range(n)], [hashlib.sha256(t.encode()).hexdigest() for t in texts], *(kept[k]() for k in keep)]
