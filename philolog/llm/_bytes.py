"""Vectorised tokenising and hashing of whole texts, on the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is 64 bits
of a polynomial over random byte values, so two different words of one corpus meet with a chance
of about (distinct words)^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at once; a longer text is taken alone.
BLOCK_BYTES = 2 << 20
#: Bytes that are hashed at once: what is held beside the texts and their words is a fixed multiple of it.
WINDOW = 128 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(20).integers(1, 2**64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]


def _powers(base: int) -> np.ndarray:
    """Powers 0 .. WINDOW of a number, modulo 2^64."""
    steps = np.full(WINDOW + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits each depend on all bits given."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """Words of some texts in order: hash of each, and n + 1 offsets of the texts into them."""

    hashes: np.ndarray
    offsets: np.ndarray

    def rows(self) -> np.ndarray:
        """For each word the row of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def _finished(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of the texts data[offsets[i]:offsets[i+1]]; offsets[0] is 0.

    The bytes are hashed window by window; a word that a window's end cuts is put together again.
    """
    n = len(data)
    before, done, out = np.zeros(len(offsets), np.int64), 0, []
    open_sum, open_length = 0, 0
    for lo in range(0, n, WINDOW):
        hi = min(lo + WINDOW, n)
        inner = ~_SPACE[data[lo:hi]]
        first, last = inner.copy(), inner.copy()
        first[1:] &= ~inner[:-1]
        last[:-1] &= ~inner[1:]
        edges = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "left")] - lo
        fresh = bool(len(edges)) and edges[0] == 0
        edges = edges[edges > 0]
        first[edges] |= inner[edges]
        last[edges - 1] |= inner[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUE[data[lo:hi]] * _POWER[: hi - lo], out=sums[1:])
        sums, lengths = (sums[ends] - sums[starts]) * _INVERSE[starts], ends - starts
        if open_length:
            if inner[0] and not fresh:
                # the open word goes on: its start lies before this window, so it isn't counted here
                sums[0] = np.uint64((open_sum + pow(_BASE, open_length, 2**64) * int(sums[0])) % 2**64)
                lengths[0] += open_length
                starts = starts[1:]
            else:
                out.append(_finished(np.array([open_sum], np.uint64), np.array([open_length])))
            open_length = 0
        inside = slice(np.searchsorted(offsets, lo, "left"), np.searchsorted(offsets, hi, "left"))
        before[inside] = done + np.searchsorted(starts, offsets[inside] - lo, "left")
        done += len(starts)
        if hi < n and inner[-1]:
            open_sum, open_length = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        out.append(_finished(sums, lengths))
    if open_length:
        out.append(_finished(np.array([open_sum], np.uint64), np.array([open_length])))
    before[offsets >= n] = done
    return Words(np.concatenate(out) if out else np.zeros(0, np.uint64), before)


def word_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) for each block of a text column."""
    data, offsets = utf8(column)
    for lo, hi in blocks(offsets, limit):
        at = offsets[lo : hi + 1]
        yield lo, hi, words(data[at[0] : at[-1]], at - at[0])
