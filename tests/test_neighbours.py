"""Approximate neighbours against all cosines."""

import math

import numpy as np
import pytest

import __spark_entry__
from philolog.operators import neighbours


def exact(ids, x, queries, k, able=None):
    """query: its k nearest others as (score, id)."""
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        scores = np.round(units @ units[ids.index(q)], 9)
        out[q] = sorted((-s, i) for s, i, ok in zip(scores.tolist(), ids, able or [True] * len(ids), strict=True) if i != q and ok)[:k]
    return out


def recall(found, want):
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], set()).add(r["id"])
    return sum(len(by_query.get(q, set()) & {i for _, i in best}) for q, best in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("name", ["neighbours_approximate", "neighbours_by_language"])
@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_the_queries(spark, name, folder):
    """All queries whose id is divisible by 50, of each size given: 0.9 of the true neighbours and more."""
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    able = [r["label"] % 5 == 4 or r["label"] % 2 == 0 for r in rows] if name.endswith("language") else None
    want = exact(ids, x, [i for i in ids if i % 50 == 0], 10, able)
    found = __spark_entry__.queries()[name](spark, f"/root/testdata/{folder}").collect()
    assert recall(found, want) >= 0.9 and len(found) == 10 * len(want)
    true = {q: dict((i, -s) for s, i in exact(ids, x, [q], len(ids), able)[q]) for q in list(want)[:5]}
    for r in found:
        if r["query_id"] in true:
            assert math.isclose(r["score"], true[r["query_id"]][r["id"]], abs_tol=2e-9)


def test_groups_need_few_cells(spark, tmp_path):
    """Grouped vectors: a query looks into a small part of the cells, and recall holds."""
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((40, 18))
    x = centres[draw.integers(0, 40, 6000)] + 0.1 * draw.standard_normal((6000, 18))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    index = neighbours.build(frame, str(tmp_path))
    assert index.model.probes < len(index.model.centroids) / 4
    queries = [i for i in range(6000) if i % 50 == 0]
    found = index.search(frame.where("vec_id % 50 = 0"), 10, others=True).collect()
    assert recall(found, exact(list(range(6000)), x, queries, 10)) >= 0.9
    again = neighbours.opened(spark, str(tmp_path))
    assert sorted(map(tuple, again.search(frame.where("vec_id % 50 = 0"), 10, others=True).collect())) == sorted(map(tuple, found))


def test_small_tiles_give_the_same(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(2)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(draw.standard_normal((700, 6)).tolist())], "vec_id long, embedding array<double>")
    index = neighbours.build(frame, str(tmp_path))
    want = sorted(map(tuple, index.search(frame, 3).collect()))
    monkeypatch.setattr(neighbours, "TILE", 16)
    monkeypatch.setattr(neighbours, "QUERY_TILE", 5)
    assert sorted(map(tuple, index.search(frame, 3).collect())) == want


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0], "en", "x"), (2, [2.0, 0.0], "zh", "x"), (3, [0.0, 1.0], "zh_en", "x"), (4, [0.0, 0.0], "en", "x"), (5, None, "en", "x"), (6, [float("nan"), 1.0], "en", "x"), (7, [1.0, None], "en", "x"), (8, [1.0], "en", "x"), (None, [1.0, 1.0], None, None), (9, [1e300, 1e300], None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, lang string, cell string")
    index = neighbours.build(frame, str(tmp_path), language_col="lang")
    assert index.version.rows["coded"] == 4
    found = {(r["query_id"], r["rank"]): r["id"] for r in index.search(frame, 2).collect()}
    assert found == {(1, 1): 1, (1, 2): 2, (2, 1): 1, (2, 2): 2, (3, 1): 3, (3, 2): 9, (9, 1): 9, (9, 2): 1}
    assert {r["id"] for r in index.search(frame, 5, language="en").collect()} == {1, 3}
    empty = neighbours.build(frame.limit(0), str(tmp_path / "empty"))
    assert empty.search(frame, 2).collect() == []
