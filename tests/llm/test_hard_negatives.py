"""Hard negatives against all scores and DuckDB."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from philolog.llm import hard_negatives, registry
from philolog.llm.queries_negatives import _OP13

SCHEMA = "vec_id long, embedding array<float>, label int, key string, home string, score string"


def plain(rows):
    """The same by all pairs; rows equal in id, label and vector once."""
    able = {}
    for i, x, label, *_ in rows:
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            able[i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * v) for v in x)] = None
    able, out = list(able), []
    for a in able:
        if a[0] % 50 == 0:
            scored = sorted((-sum(u * v for u, v in zip(a[2], x[2], strict=True)), x[0], x) for x in able if x != a and len(x[2]) == len(a[2]))
            for s, i, _ in [y for y in scored if y[2][1] == a[1]][:5]:
                fit = [y for y in scored if y[2][1] != a[1] and 50 * -s <= 100 * -y[0] <= 95 * -s][:3]
                out += [(a[0], i, k, j, -s, -t) for k, (t, j, _) in enumerate(fit, 1)]
    return sorted(out)


def odd_rows():
    draw = random.Random(2)
    centres = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    near = lambda c: [float(round((v + draw.gauss(0, 0.2)) * 64) / 64) for v in c]
    rows = [(i, near(centres[draw.randrange(4)]), draw.randrange(3), "?", "?", None) for i in range(1200)]
    rows += [(3000 + i, [0.5, 0.25, 0.0, 0.0, 1.0, 0.5], i % 2, "?", None, None) for i in range(200)]  # one vector, many times
    rows += [(50, None, 1, "", "", ""), (100, [None, 1.0], 1, "", "", ""), (150, [math.nan] * 6, 1, "", "", ""), (200, [math.inf] + [0.0] * 5, 1, "", "", ""), (None, [1.0] * 6, 1, "", "", ""), (250, [1.0] * 6, None, "", "", "")]
    rows += [rows[100], rows[100], (5000, [1.0, 2.0], 1, "", "", ""), (5001, [2.0, 1.0], 1, "", "", ""), (5002, [0.5, 1.5], 2, "", "", ""), (5050, [], 1, "", "", ""), (5051, [], 1, "", "", ""), (5053, [], 2, "", "", ""), (6000, [0.0] * 6, 0, "", "", ""), (6050, [3e38] * 6, 0, "", "", "")]
    return rows


def mined(spark, rows):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).withColumn("label", moved), "vec_id % 50 = 0").collect())


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, small, monkeypatch):
    """Many pivots and small tiles find the same as one group."""
    if small:
        for name, value in (("ANCHORS_PER_PIVOT", 2), ("ANCHOR_TILE", 3), ("TILE", 40)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = odd_rows()
    want = [r for r in plain([x for x in rows if x[0] != 6050])]
    assert mined(spark, rows) == want and len(want) > 100


def test_cells_keep_candidates_away(spark, monkeypatch):
    """Of far clusters, a group is sent hardly any row of another."""
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_PIVOT", 4)
    draw = random.Random(3)
    rows = [(i, [float(20 * (i % 4 == k)) + draw.gauss(0, 0.1) for k in range(4)], (i // 4) % 2, "", "", "") for i in range(2000)]
    sent = []
    real = hard_negatives._sent
    monkeypatch.setattr(hard_negatives, "_sent", lambda *a: sent.append(real(*a)) or sent[-1])
    assert mined(spark, rows) == plain(rows)
    assert sent[0].count() < 2000


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1, "", "", "")]) == []
    assert mined(spark, [(50, [1.0], 1, "", "", "")]) == []


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.execute(_OP13).fetchall()
    rows = registry.queries()["op13_hard_negatives"](spark, folder)
    assert rows.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
