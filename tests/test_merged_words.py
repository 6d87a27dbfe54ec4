"""Lists, runs and scores from rows merged as texts are cut."""

import pytest
from pyspark.sql import functions as F

from philolog.functions import text as X
from philolog.operators import collocation, index, lists, retrieval
from tests.test_cutting import ROWS, same


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(2)


def plan(rows):
    return rows._jdf.queryExecution().toString()


def test_lists_of_merged_words(texts):
    same(index.word_totals(index.term_table(texts)), index.word_totals(index.token_table(texts, offsets=True)))
    options = {"stop": ["the"], "min_frequency": 2}
    rows = lists.dynamic_list(index.term_table(texts), **options)
    same(rows, lists.dynamic_list(index.token_table(texts, offsets=True), **options))
    # a task does not hold what it sends: no merging before rows are dealt
    assert "RepartitionByExpression" in plan(rows)
    with pytest.raises(ValueError):
        lists.dynamic_list(index.term_table(texts), case_sensitive=True)


def test_runs_are_dealt_over_parts_of_their_own(texts):
    """However few parts the session has: a part must be sorted in memory."""
    for rows in (lists.ngrams(texts, 3), lists.open_slot_ngrams(texts, 3, 2)):
        assert f"{lists.RUN_PARTS}), REPARTITION_BY_NUM" in plan(rows) or f"{lists.RUN_PARTS}, REPARTITION_BY_NUM" in plan(rows).replace("), ", ", ")


def test_scores_of_terms_counted_in_arrow(texts):
    query, found = "The thing", X.retrieval_terms(F.coalesce("text", F.lit("")))
    want = texts.select(F.size(found), *[F.size(F.array_compact(F.transform(found, lambda x: F.nullif(F.lit(True), x != F.lit(w))))) for w in ("the", "thing")])
    batch = texts.select(F.col("doc_id").alias("id"), "text").toArrow().combine_chunks().to_batches()[0]
    got = [tuple(r.values())[1:] for b in retrieval._counter(["the", "thing"])(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert sorted(got) == sorted(map(tuple, want.collect()))
    assert "regexp_extract_all" not in plan(retrieval.bm25(texts, query))


def test_cells_of_a_plot_are_read_once(texts):
    rows = collocation.plot(index.token_table(texts), "the", "", 20)
    assert plan(rows).split("Physical Plan")[1].count("MapInArrow") == 2


def test_counts_of_a_corpus(texts):
    tokens = index.token_table(texts, offsets=True)
    got = index.corpus_counts(texts)
    assert "posexplode" not in plan(got)
    assert (got.first()["tokens"], got.first()["types"]) == (tokens.count(), tokens.select("language", "normalized").distinct().count())
