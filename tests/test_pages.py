"""Pages against whole sorts, and patterns that run out of time."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from philolog.operators import concordance, index, pages
from philolog.plans.query import PatternTimeout, pattern_errors
from tests.test_catalogue import duck, plain  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(6)
    made = [(draw.choice(["a", "b", "b", None, "ß", "z"]), draw.choice([1.5, None, -2.0, 0.0]), k % 50, k) for k in range(3000)]
    return spark.createDataFrame(made, "word string, x double, n int, id long").repartition(6).cache()


@pytest.mark.parametrize("keys", [["word"], ["-word", "x"], ["n", "-x", "word"], ["-x"], []])
def test_pages_equal_a_whole_sort(rows, keys):
    order = [pages.Key(F.col(k.lstrip("-")), k.startswith("-")) for k in keys] + [pages.Key(F.col("id"), len(keys) == 2)]
    whole = [r["id"] for r in rows.orderBy(*[k.order() for k in order]).collect()]
    for number, size in [(1, 10), (7, 100), (30, 100), (99, 100), (2, 1999), (3000, 1), (0, 5), (1, 5000)]:
        found = pages.page(rows, order, number, size, ranges=8, at_once=50)
        at = (found.page - 1) * size
        assert [r["id"] for r in found.rows.collect()] == whole[at : at + size]
        assert found.total == 3000 and found.pages == -(-3000 // size)


def test_a_page_sorts_little(rows):
    """No sort of all rows: the plan has no exchange by ranges, and few rows reach the last step."""
    found = pages.page(rows, [pages.Key(F.col("word")), pages.Key(F.col("id"))], 12, 50, ranges=16, at_once=100)
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_rows_are_worked_out_once(spark, rows):
    """However often a page's ranges are counted."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    own = rows.mapInArrow(counted, rows.schema)
    for number in (1, 12):
        seen.value = 0
        found = pages.page(own, [pages.Key(F.col("id"))], number, 50, at_once=100)
        assert [r["id"] for r in found.rows.collect()] == list(range(50 * number - 50, 50 * number)) and seen.value == 3000


def test_frequencies_by_join(rows):
    """kpf with nulls among the keys, of hits spread over tasks and of those in one window."""
    kinds = [sorted(map(tuple, concordance.pattern_frequency(rows.select(F.col("word").alias("C"), F.col("x").alias("R1"), "id"), ["C", "R1"], spread=s).collect()), key=repr) for s in (False, True)]
    assert kinds[0] == kinds[1] and len(kinds[0]) == 3000


def test_equal_keys_and_no_rows(spark, rows):
    same = pages.page(rows.select(F.lit(1).alias("k")), [pages.Key(F.col("k"))], 3, 1000, at_once=10)
    assert same.rows.count() == 1000
    empty = pages.page(rows.limit(0), [pages.Key(F.col("id"))], 4, 10)
    assert (empty.total, empty.page, empty.pages, empty.rows.count()) == (0, 1, 1, 0)
    with pytest.raises(ValueError):
        pages.page(rows, [pages.Key(F.col("id"))], 1, 0)


@pytest.mark.parametrize("name", ["kwic_page", "kwic_page_by_frequency", "pattern_tokens"])
def test_against_sql(spark, duck, name):  # noqa: F811
    out = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(out.columns)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in out.collect()), key=repr)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert own == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr) and own


def test_a_catastrophic_pattern_ends_in_a_typed_error(spark):
    texts = spark.createDataFrame([(1, "a fine text", "en"), (2, "a" * 60 + "b", "en")], "doc_id long, text string, lang string")
    with pytest.raises(PatternTimeout), pattern_errors():
        concordance.pattern_hits(texts, r"(a|a|aa)+c").collect()
    with pytest.raises(PatternTimeout), pattern_errors():
        concordance.pattern_tokens(index.token_table(texts), r"(a|a|aa)+c").collect()
    assert concordance.pattern_hits(texts, r"fine \w+").first()["text"] == "fine text"


def test_other_errors_pass(spark):
    def fails(values):
        raise RuntimeError("no time matter")

    with pytest.raises(Exception, match="no time matter"), pattern_errors():
        spark.range(1).select(F.pandas_udf(fails, "long", F.PandasUDFType.SCALAR)("id")).collect()
