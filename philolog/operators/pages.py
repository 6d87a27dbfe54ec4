"""One page of a long result without sorting all of it.

Rows are worked out once and held on disk while the page is sought. A page near the top is cut from
the first rows that each task keeps. Else:
Rows are counted by ranges of the order's keys, whose bounds come from a sample of keys. Only the
ranges in which the page lies are kept; if they are still many rows, they are divided again. What is
sorted in the end is about a page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of one pass (few, so that the tests of all bounds fit one generated method), keys sampled for each bound, and rows that are sorted at once.
RANGES, PER_BOUND, SORTED_ROWS = 16, 32, 20_000


@dataclass(frozen=True)
class Key:
    """A part of an order. Nulls come first, or last if it falls, as in Spark's own orders."""

    column: Column
    falling: bool = False

    def order(self) -> Column:
        return self.column.desc() if self.falling else self.column.asc()

    def before(self, bound) -> Column:
        """Whether a row's value stands before the bound."""
        if bound is None:
            return self.column.isNotNull() if self.falling else F.lit(False)
        limit = F.lit(bound)
        return F.coalesce(self.column > limit, F.lit(False)) if self.falling else F.coalesce(self.column < limit, F.lit(True))


@dataclass
class Page:
    total: int
    page: int
    pages: int
    rows: DataFrame


def _before(keys: list[Key], bound: tuple) -> Column:
    """Whether a row stands before the bound in the whole order."""

    def either(k: int) -> Column:
        first = keys[k].before(bound[k])
        return first if k + 1 == len(keys) else first | (keys[k].column.eqNullSafe(F.lit(bound[k])) & either(k + 1))

    return either(0)


def _range(keys: list[Key], bounds: list[tuple], low: int = 0) -> Column:
    """The number of bounds that a row doesn't stand before, found by halving."""
    if not bounds:
        return F.lit(low)
    middle = len(bounds) // 2
    return F.when(_before(keys, bounds[middle]), _range(keys, bounds[:middle], low)).otherwise(_range(keys, bounds[middle + 1 :], low + middle + 1))


def _bounds(rows: DataFrame, keys: list[Key], total: int, ranges: int) -> list[tuple]:
    """Keys of a sample at equal steps; about ranges x PER_BOUND keys come to the driver."""
    names = [f"_k{i}" for i in range(len(keys))]
    share = min(1.0, ranges * PER_BOUND / max(total, 1))
    some = rows.select(*[k.column.alias(n) for k, n in zip(keys, names, strict=True)]).sample(share, 5)
    found = [tuple(r) for r in some.orderBy(*[Key(F.col(n), k.falling).order() for n, k in zip(names, keys, strict=True)]).collect()]
    step = max(1, len(found) // ranges)
    return list(dict.fromkeys(found[step::step]))


def page(rows: DataFrame, keys: list[Key], number: int, size: int, *, ranges: int = RANGES, at_once: int = SORTED_ROWS) -> Page:
    """The page of this number, from 1; beyond the last page the last one. keys must tell any two rows apart, or rows may share a place.

    Rows are worked out once, so they should have no columns but the page's. What is held is read a few
    times, each time by filters alone: nothing but the page's ranges is sorted.
    """
    if size < 1:
        raise ValueError("a page has one row at least")
    rows = rows.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    first, held, there = (number - 1) * size, rows, total
    while there > max(at_once, 2 * size) and first + size > at_once:
        bounds = _bounds(held, keys, there, ranges)
        placed = held.withColumn("_range", _range(keys, bounds))
        counts = dict(map(tuple, placed.groupBy("_range").count().collect()))  # a row for each range
        before, wanted, passed = 0, [], 0
        for k in range(len(bounds) + 1):
            n = counts.get(k, 0)
            if before + n > first and before < first + size:
                wanted.append(k)
            elif before + n <= first:
                passed = before + n
            before += n
        now = sum(counts.get(k, 0) for k in wanted)
        if not wanted or now == there:  # rows of one key only
            break
        held, first, there = placed.where(F.col("_range").between(wanted[0], wanted[-1])).drop("_range"), first - passed, now
    return Page(total, number, pages, held.orderBy(*[k.order() for k in keys]).offset(first).limit(size))


def concordance_keys(keys: list[str], by_frequency: bool = False) -> list[Key]:
    """A concordance's order as sort_columns() has it: missing neighbours last, ties by document and position."""
    out = [Key(F.col("kpf"), True)] if by_frequency and keys else []
    for k in keys:
        name = "document_id" if k in ("FILE", "FILE_ID") else "stream_position" if k == "ROW_ID" else k
        out += [Key(F.col(name).isNull()), Key(F.col(name))]
    return [*out, Key(F.col("document_id")), Key(F.col("stream_position"))]
