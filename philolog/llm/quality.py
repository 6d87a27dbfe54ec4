"""Quality of texts by a sparse rule ensemble, compiled into Spark columns.

Statistics of each text are Spark columns. Small trees are grown on differently drawn halves of a
bounded sample of labelled rows; every path from a root becomes a rule, a conjunction of comparisons.
A logistic model with a lasso penalty over the rules keeps few of them, and its rules and weights are
compiled into one column expression, which scores every row in the JVM.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on, about; chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Trees, their depth, candidate thresholds of a statistic; a leaf has a fiftieth of the rows, within these bounds.
TREES, DEPTH, CUTS, LEAF = 24, 3, 16, (3, 20)
#: Lasso penalty, steps of its solver.
PENALTY, STEPS = 0.002, 400
SEED = 10


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a whole text; a null one counts as empty. All are 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.col("_words")
    count = F.size(words)
    many = F.greatest(count, F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / n

    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    return {
        "log_words": F.log1p(count),
        "word_length": F.length(t) / many,
        "distinct": F.size(F.array_distinct(words)) / many,
        "letters": letters / n,
        "capitals": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "marks": share(r"[^\p{L}\p{N}\s.,]"),
        "stops": share(r"[.,]"),
        "exclaims": share(r"!"),
        "bars": share(r"\|"),
        "lines": share(r"\n"),
        "braces": share(r"[{}<>=;#$%&*_\\/]"),
        "licence": F.when(t.rlike("(?i)licen[sc]e|copyright|all rights reserved"), 1.0).otherwise(0.0),
    }


def described(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with `_stats`, a struct of the statistics."""
    work = docs.withColumn("_words", F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    stats = statistics(F.col(text_col))
    return work.withColumn("_stats", F.struct(*[F.round(c.cast("double"), 6).alias(k) for k, c in stats.items()])).drop("_words")


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is at most / is above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, low, cut in self.terms:
            out &= (x[:, k] <= cut) == low
        return out

    def column(self, names: list[str], stats: Column) -> Column:
        out = F.lit(True)
        for k, low, cut in self.terms:
            out = out & (stats[names[k]] <= cut if low else stats[names[k]] > cut)
        return out


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, stats: Column) -> Column:
        margin = F.lit(self.bias)
        for rule, weight in self.rules:
            margin = margin + F.when(rule.column(self.names, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, columns: list[int], depth: int, leaf: int, path: tuple, out: set[Rule]) -> None:
    if path:
        out.add(Rule(path))
    mean = y[rows].mean()
    if depth == 0 or len(rows) < 2 * leaf or mean in (0.0, 1.0):
        return
    best = None
    for k in columns:
        below = x[rows, k][:, None] <= cuts[k][None, :]
        n = below.sum(0)
        s = (below * y[rows][:, None]).sum(0)
        other, rest = len(rows) - n, y[rows].sum() - s
        fits = (n >= leaf) & (other >= leaf)
        if fits.any():
            gain = np.where(fits, s**2 / np.maximum(n, 1) + rest**2 / np.maximum(other, 1), -1)
            i = int(gain.argmax())
            if best is None or gain[i] > best[0]:
                best = (gain[i], k, float(cuts[k][i]))
    if best is None or best[0] <= len(rows) * mean**2 + 1e-9:
        return
    _, k, cut = best
    low = x[rows, k] <= cut
    for side in (True, False):
        _grow(x, y, cuts, rows[low == side], columns, depth - 1, leaf, (*path, (k, side, cut)), out)


def rules_of(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of trees on halves of the rows and of the statistics."""
    draw, out = random.Random(SEED), set()
    leaf = min(max(len(y) // 50, LEAF[0]), LEAF[1])
    cuts = [np.unique(np.round(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1]), 6)) for k in range(x.shape[1])]
    for _ in range(TREES):
        rows = np.array(sorted(draw.sample(range(len(y)), max(1, len(y) * 2 // 3))))
        columns = sorted(draw.sample(range(x.shape[1]), -(-x.shape[1] * 2 // 3)))
        _grow(x, y, cuts, rows, columns, DEPTH, leaf, (), out)
    return sorted(out, key=lambda r: (len(r.terms), r.terms))


def lasso(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights of the penalised logistic fit, by accelerated proximal steps."""
    n, p = z.shape
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    bias, w = math.log(prior / (1 - prior)), np.zeros(p)
    back, v, t = bias, w.copy(), 1.0
    size = 4.0 / max(1.0, np.linalg.norm(z.T @ z / n, 2) + 1.0) if p else 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(z @ v + back, -30, 30))) - y
        new_bias = back - size * error.mean()
        raw = v - size * (z.T @ error) / n
        new = np.sign(raw) * np.maximum(np.abs(raw) - size * PENALTY, 0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, back, t = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias), after
        w, bias = new, new_bias
    return bias, w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the documents with one label, 0 or 1. Of more than SAMPLE_ROWS labels about so many are drawn, which bounds what is broadcast, and of the rows that bear them at most about twice so many, whatever ids are repeated."""
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("_most"))
    labels = labels.where("y = _most and y in (0, 1)").select(F.col(id_col).alias("_id"), F.col("y").cast("double").alias("y"))
    n = labels.count()
    if n > SAMPLE_ROWS:
        labels = labels.where(F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(1 << 30)) < (SAMPLE_ROWS << 30) // n)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(labels), "_id")
    most = 2 * SAMPLE_ROWS
    if (there := rows.count()) > most:
        rows = rows.sample(most / there, SEED)
    found = described(rows, "text").select("_id", "y", "_stats.*").collect()
    names = list(statistics(F.lit("")))
    if not found:
        return Model(names)
    found.sort(key=lambda r: (r["_id"] is None, r["_id"] or 0, tuple(r)[1:]))
    y = np.array([r["y"] for r in found])
    x = np.array([[r[k] for k in names] for r in found])
    rules = rules_of(x, y)
    z = np.stack([r.holds(x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    _, first = np.unique(z, axis=1, return_index=True) if rules else (None, np.zeros(0, int))
    first = np.sort(first)
    bias, w = lasso(z[:, first], y)
    return Model(names, bias, [(rules[k], float(w[i])) for i, k in enumerate(first.tolist()) if abs(w[i]) > 1e-9])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 if score >= 0.5), in place of columns of these names.

    Every row is scored, empty and null texts as the empty text; without labels to fit, the score is 0.5.
    """
    work = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    out = described(work, "_text").select("_row", model.score(F.col("_stats")).alias("score"))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("score", "predicted")]
    return out.select(*kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
