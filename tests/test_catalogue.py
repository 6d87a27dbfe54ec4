"""Some registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
NAMES = ["word_list_en", "ngrams_2", "open_slot", "clusters_right", "kwic_phrase", "kwic_sorted", "kwic_sample", "cqp_slot", "keywords", "collocates", "dispersion", "parallel_nth", "audit_summary", "rrf", "eval_metrics", "events_dedup"]


def plain(value):
    return round(value, 4) if isinstance(value, float) else float(value) if hasattr(value, "is_finite") else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    return con


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    rows = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(rows.columns)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert len(own) == len(theirs) and all(a == b or all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-4) for x, y in zip(a, b, strict=True)) for a, b in zip(own, theirs, strict=True))
