"""Filters of fixed size over 64-bit keys, built in segments by Spark tasks: which keys may be in a
set, and which may occur some times at least. Both err to one side alone: as they fill, more keys pass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter and of the segments that it is built in, as powers of 2.
BLOOM_BITS, SEGMENT_BITS = 27, 17
#: Cells of one low byte in a segment's packed counts.
_LOW = 256


@dataclass
class Bloom:
    """Which keys may be in a set; bits are those of a key's segment at two places."""

    bits: np.ndarray

    @staticmethod
    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        segment = keys >> np.uint64(64 - BLOOM_BITS + SEGMENT_BITS) << np.uint64(SEGMENT_BITS)
        inner = np.uint64((1 << SEGMENT_BITS) - 1)
        return segment | keys & inner, segment | keys >> np.uint64(SEGMENT_BITS) & inner

    def may(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    @classmethod
    def of(cls, keys: DataFrame) -> Bloom:
        """Of the column `key`: each segment is built by one task, and 2^BLOOM_BITS bits come to the driver."""

        def build(table: pa.Table) -> pa.Table:
            k = table["key"].to_numpy().view(np.uint64)
            flags = np.zeros(1 << SEGMENT_BITS, np.uint8)
            for at in cls.places(k):
                flags[at & np.uint64((1 << SEGMENT_BITS) - 1)] = 1
            return pa.table({"segment": pa.array([int(k[0] >> np.uint64(64 - BLOOM_BITS + SEGMENT_BITS))], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

        segment = F.shiftrightunsigned("key", 64 - BLOOM_BITS + SEGMENT_BITS).cast("int")
        bits = np.zeros(1 << BLOOM_BITS - 3, np.uint8)
        size = 1 << SEGMENT_BITS - 3
        for r in keys.select("key", segment.alias("_segment")).groupBy("_segment").applyInArrow(lambda t: build(t), "segment int, bits binary").toLocalIterator():
            bits[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits)


@dataclass
class Frequent:
    """Which keys may have occurred `least` times or more: each key has a cell, and a cell's count is that of all its keys."""

    bits: np.ndarray
    least: int

    @staticmethod
    def cells(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)

    def may(self, keys: np.ndarray) -> np.ndarray:
        at = self.cells(keys)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    @staticmethod
    def packed(cells: np.ndarray, times: np.ndarray, least: int):
        """(segment, bytes) of sorted distinct cells with counts: how many cells each run of _LOW has, their low bytes, their counts up to least."""
        if not len(cells):
            return
        times = np.minimum(times, least).astype(np.uint8)
        segments = cells >> SEGMENT_BITS
        cuts = np.flatnonzero(np.diff(segments)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
            inner = cells[lo:hi] & ((1 << SEGMENT_BITS) - 1)
            runs = np.bincount(inner // _LOW, minlength=(1 << SEGMENT_BITS) // _LOW).astype("<u2")
            yield int(segments[lo]), runs.tobytes() + (inner % _LOW).astype(np.uint8).tobytes() + times[lo:hi].tobytes()

    @staticmethod
    def bits_of(parts: list[bytes], least: int) -> bytes:
        """The segment's bits, from packed counts of it."""
        total, runs = np.zeros(1 << SEGMENT_BITS, np.int64), (1 << SEGMENT_BITS) // _LOW
        for part in parts:
            sizes = np.frombuffer(part, "<u2", runs)
            n = int(sizes.sum())
            low, times = np.frombuffer(part, np.uint8, n, 2 * runs), np.frombuffer(part, np.uint8, n, 2 * runs + n)
            total[np.repeat(np.arange(runs) * _LOW, sizes) + low] += times
        return np.packbits(total >= least, bitorder="little").tobytes()


def frequent(columns: DataFrame, keys_of, kinds: int, least: int, held: int) -> list[Frequent]:
    """A filter for each kind of keys: keys_of(Arrow column) yields an array of keys per kind, again and again, for all occurrences.

    Tasks hold up to `held` cells, and what they pass on takes about two bytes a cell. A segment's
    parts meet in one task; there are 2^(BLOOM_BITS - SEGMENT_BITS) of each kind.
    """

    def count(batches):
        parts: list[list] = [[] for _ in range(kinds)]
        size = 0

        def flush():
            for kind, own in enumerate(parts):
                if own:
                    cells, at = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
                    times = np.bincount(at, np.concatenate([n for _, n in own]), len(cells))
                    rows = list(Frequent.packed(cells, times, least))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["kind", "segment", "packed"])
                own.clear()

        for batch in batches:
            for keys in keys_of(batch.column(0)):
                for own, k in zip(parts, keys, strict=True):
                    own.append(np.unique(Frequent.cells(k), return_counts=True))
                    size += len(own[-1][0])
                if size > held:
                    yield from flush()
                    size = 0
        yield from flush()

    def build(table: pa.Table) -> pa.Table:
        return pa.table({"kind": table["kind"][:1], "segment": table["segment"][:1], "bits": pa.array([Frequent.bits_of(table["packed"].to_pylist(), least)], pa.binary())})

    out = [np.zeros(1 << BLOOM_BITS - 3, np.uint8) for _ in range(kinds)]
    size = 1 << SEGMENT_BITS - 3
    counted = columns.mapInArrow(count, "kind int, segment int, packed binary")
    for r in counted.groupBy("kind", "segment").applyInArrow(lambda t: build(t), "kind int, segment int, bits binary").toLocalIterator():
        out[r["kind"]][r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return [Frequent(bits, least) for bits in out]
