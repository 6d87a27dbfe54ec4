"""The banded alignment against a table of all cells."""

import math
import random
import time
import tracemalloc

import pytest

from philolog.sources import importers
from philolog.sources.importers import LESS_SURE, RATIO_BOUNDS, STEPS, SURE, align_lengths


def plain(a, b):
    """Every cell in a dictionary, one after the other."""
    ratio = min(max(sum(b) / max(sum(a), 1), RATIO_BOUNDS[0]), RATIO_BOUNDS[1])

    def stretch(i: int, i2: int, j: int, j2: int) -> float:
        return abs(math.log((sum(b[j:j2]) + 1) / (sum(a[i:i2]) * ratio + 1))) if i2 > i and j2 > j else 0.0

    best: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {(0, 0): (0.0, None)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            here = best.get((i, j))
            if here is None:
                continue
            for (da, db), extra in STEPS.items():
                to = (i + da, j + db)
                if to[0] <= len(a) and to[1] <= len(b):
                    cost = here[0] + stretch(i, to[0], j, to[1]) + extra
                    if to not in best or cost < best[to][0]:
                        best[to] = (cost, (i, j))
    out, at = [], (len(a), len(b))
    while best[at][1] is not None:
        i, j = best[at][1]
        i2, j2 = at
        top = 0.0 if i == i2 or j == j2 else (SURE if i2 - i == j2 - j == 1 else LESS_SURE) * math.exp(-stretch(i, i2, j, j2))
        out.append((i, i2, j, j2, round(top, 4)))
        at = (i, j)
    return out[::-1]


@pytest.mark.parametrize("width", [1, 64])
def test_equals_all_cells(width, monkeypatch):
    monkeypatch.setattr(importers, "FIRST_WIDTH", width)
    draw = random.Random(width)
    for _ in range(250):
        top = draw.choice([1, 3, 100])
        a, b = ([draw.randint(0, top) for _ in range(draw.randint(0, 40))] for _ in range(2))
        assert align_lengths(a, b) == plain(a, b)


def test_texts_that_lack_parts():
    """A stretch that one side lacks lies far from the straight line."""
    draw = random.Random(3)
    a = [draw.randint(20, 400) for _ in range(300)]
    b = [x + draw.randint(-3, 3) for x in a[:40] + a[140:]]
    assert align_lengths(a, b) == plain(a, b)


def test_long_lists_in_bounded_memory():
    draw = random.Random(4)
    a = [draw.randint(10, 500) for _ in range(10_000)]
    b = [int(1.3 * x) + draw.randint(0, 20) for x in a]
    tracemalloc.start()
    began, steps = time.time(), align_lengths(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert steps[-1][1] == steps[-1][3] == 10_000 and peak < 500e6 and time.time() - began < 120
