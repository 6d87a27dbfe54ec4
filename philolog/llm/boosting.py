"""Gradient boosting of small trees over a table of counted feature combinations.

The table is as long as there are different combinations of binned features, however many rows it
stands for. Trees become nested CASE expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Depth of a tree, step of a tree's values, and what is added to a leaf's weight.
DEPTH, STEP, RIDGE = 3, 0.4, 1.0


@dataclass
class Cell:
    """A combination of features with its numbers of positive and negative rows."""

    features: tuple[int, ...]
    positive: float
    negative: float
    margin: float = 0.0


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _grow(cells: list[tuple[Cell, float, float]], depth: int):
    """A leaf value, or (feature, threshold, left, right)."""
    g, h = sum(x[1] for x in cells), sum(x[2] for x in cells)
    best, base = None, g * g / (h + RIDGE)
    for k in range(len(cells[0][0].features) if depth else 0):
        sums: dict[int, list[float]] = {}
        for cell, a, b in cells:
            s = sums.setdefault(cell.features[k], [0.0, 0.0])
            s[0] += a
            s[1] += b
        left_g = left_h = 0.0
        for value in sorted(sums)[:-1]:
            left_g += sums[value][0]
            left_h += sums[value][1]
            gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - base
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = (gain, k, value)
    if best is None:
        return STEP * g / (h + RIDGE)
    _, k, value = best
    return k, value, _grow([x for x in cells if x[0].features[k] <= value], depth - 1), _grow([x for x in cells if x[0].features[k] > value], depth - 1)


def value_of(tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def fit(cells: list[Cell], rounds: int) -> tuple[float, list]:
    """Prior margin and trees; sets the margins of the cells."""
    positive, negative = sum(c.positive for c in cells), sum(c.negative for c in cells)
    prior = math.log((positive + 0.5) / (negative + 0.5))
    trees = []
    for c in cells:
        c.margin = prior
    for _ in range(rounds if positive and negative else 0):
        moved = []
        for c in cells:
            p, n = sigmoid(c.margin), c.positive + c.negative
            moved.append((c, c.positive - n * p, n * p * (1 - p)))
        trees.append(_grow(moved, DEPTH))
        for c in cells:
            c.margin += value_of(trees[-1], c.features)
    return prior, trees


def calibrated(cells: list[Cell], prior: float, trees: list, precision: float) -> float | None:
    """Least margin at and above which these rows have the precision; None if none does."""
    scored = sorted(((prior + sum(value_of(t, c.features) for t in trees), c) for c in cells), key=lambda x: -x[0])
    found, positive, total = None, 0.0, 0.0
    for i, (margin, c) in enumerate(scored):
        positive += c.positive
        total += c.positive + c.negative
        if (i + 1 == len(scored) or scored[i + 1][0] < margin) and total and positive >= precision * total:
            found = margin
    return found


def margin_column(features: list[Column], prior: float, trees: list) -> Column:
    def column(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        k, value, low, high = tree
        return F.when(features[k] <= value, column(low)).otherwise(column(high))

    out = F.lit(float(prior))
    for tree in trees:
        out = out + column(tree)
    return out
