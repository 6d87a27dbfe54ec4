"""Hand-worked answers over three sentences of four words."""

import math
import time

import pytest
from pyspark.sql import functions as F

from philolog.functions.measures import Contingency, keyness, p_value
from philolog.operators import collocation, concordance, index, lists
from philolog.plans.query import parse_brackets, parse_simple

TEXTS = ["in terms of policy", "in terms of law", "in support of policy"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS, 1)], "doc_id long, text string, lang string").persist()


@pytest.fixture(scope="module")
def tokens(docs):
    rows = index.token_table(docs)
    return rows.withColumn("lemma", F.when(F.col("normalized") == "terms", "term").otherwise(F.col("normalized"))).persist()


def test_clusters(docs):
    (row,) = lists.clusters(docs, "in").where("frequency >= 2").collect()
    assert (row["term"], row["frequency"], row["document_range"], row["transition_probability"]) == ("in terms of", 2, 2, 1.0)
    right = lists.clusters(docs, "of", side="right", min_frequency=1).collect()
    assert {(r["term"], r["frequency"]) for r in right} == {("in terms of", 2), ("in support of", 1)}


def test_open_slot(docs):
    (row,) = lists.open_slot_ngrams(docs, 3, 2, min_frequency=3).collect()
    assert (row["pattern"], row["frequency"], row["document_range"], row["variants"]) == ("in <*> of", 3, 3, 2)
    assert row["type_token_ratio"] == pytest.approx(2 / 3) and row["entropy"] == pytest.approx(0.918296, abs=1e-6)


def test_headword_list(tokens):
    (row,) = lists.dynamic_list(tokens, kind="headword", allow=["terms"]).collect()
    assert (row["term"], row["frequency"], row["document_range"]) == ("term", 2, 2)
    with pytest.raises(ValueError):
        lists.dynamic_list(tokens, stop=["a"], allow=["b"])


def test_collocates(tokens):
    rows = {r["term"]: r for r in collocation.collocates(tokens, "terms", left=1, right=1).collect()}
    row = rows["in"]
    assert (row["frequency"], row["left_frequency"], row["right_frequency"]) == (2, 2, 0)
    assert row["log_likelihood"] > 0 and row["mi3"] > row["mi2"] > row["mi"] and 0 <= row["p_value"] <= 1
    with pytest.raises(ValueError):
        collocation.collocates(tokens, "terms", left=0, right=0)


def test_plot(tokens):
    rows = collocation.plot(tokens, "terms", "policy", 20, zero_hits=True).orderBy("document_id").collect()
    assert sum(r["hits"] for r in rows) == 2 and sum(r["overlay_hits"] for r in rows) == 2
    assert [len(r["hits_cells"]) for r in rows] == [20] * 3 and rows[0]["per_million"] == 250_000
    assert collocation.plot(tokens, "support", "", 20).count() == 1


def test_sampling_repeats(tokens):
    rows = index.with_global_position(tokens)
    hits = concordance.phrase_hits(rows, parse_simple("in")).join(rows.select("document_id", "stream_position", "global_position"), ["document_id", "stream_position"])
    first, second = (concordance.sampled(hits, 2, 42).collect() for _ in range(2))
    assert hits.count() == 3 and len(first) == 2 and first == second


def test_sorted_by_pattern_frequency(docs):
    rows = concordance.Kwic("of", sort_keys=["R1"], by_frequency=True).hits(docs)
    page = concordance.paged(rows, concordance.sort_columns(["R1"], True), 1, 1)
    (row,) = page.rows.collect()
    assert (row["R1"], row["kpf"], page.total, page.pages) == ("policy", 2, 3, 3)
    assert concordance.paged(rows, concordance.sort_columns(["R1"]), 99, 2).page == 2


def test_query_list_and_context(tokens):
    hits = concordance.union_hits([concordance.phrase_hits(tokens, parse_simple(q)) for q in ("terms", "support", "terms")])
    assert hits.count() == 3
    near = concordance.phrase_hits(tokens, parse_simple("in"))
    kept = [concordance.filter_by_context(near, tokens, parse_simple("terms"), low=1, high=1, exclude=x).count() for x in (False, True)]
    assert kept == [2, 1]


def test_phrases_cross_sentences_in_streams_only(spark):
    docs = spark.createDataFrame([(1, "One two. Three four.", "en")], "doc_id long, text string, lang string")
    rows = index.token_table(docs)
    slots = parse_brackets('"two" [] "three"')
    assert concordance.phrase_hits(rows, slots).count() == 1
    assert concordance.phrase_hits(rows, slots, scope="sentence").count() == 0
    (hit,) = concordance.phrase_hits(rows, parse_brackets('[] "two"')).collect()
    assert hit["stream_position"] == 1
    assert concordance.phrase_hits(rows, parse_brackets('[] "one"')).count() == 0


def test_full_patterns(docs):
    rows = concordance.pattern_hits(docs, r"\bin\b|$|of law").collect()
    assert sorted((r["text"], r["stream_position"], r["token_length"]) for r in rows) == [("in", 1, 1)] * 3 + [("of law", 3, 2)]


def test_file_view(spark, docs):
    spans = spark.createDataFrame([(1, 0, 2), (1, 1, 5), (1, 3, 8)], "document_id long, start int, end int")
    (row,) = concordance.file_view(docs, 1, spans).collect()
    assert [(s["text"], s["matched"]) for s in row["segments"]] == [("in", True), (" ", False), ("terms", True), (" of policy", False)]
    assert (row["tokens"], row["types"]) == (4, 4)


def test_file_view_of_many_spans(spark):
    """100,000 spans in a text of 2 MB, in time linear in both."""
    n = 100_000
    docs = spark.createDataFrame([(1, "ab cd efgh ij kl mno " * n, "en")], "doc_id long, text string, lang string")
    spans = spark.range(n).select(F.lit(1).cast("long").alias("document_id"), (F.col("id") * 21).cast("int").alias("start"), (F.col("id") * 21 + 5).cast("int").alias("end"))
    began = time.time()
    row = concordance.file_view(docs, 1, spans).select(F.size(F.filter("segments", lambda s: s["matched"])).alias("n"), F.element_at("segments", 3).alias("third")).first()
    assert row["n"] == n and tuple(row["third"]) == ("ab cd", True) and time.time() - began < 60


def test_snippets(spark):
    docs = spark.createDataFrame([(1, "A b.  C-d, e f!\n\nG h", "en")], "doc_id long, text string, lang string")
    (row,) = concordance.snippets(docs, parse_simple("e"), 2).collect()
    assert (row["left"], row["keyword"], row["right"]) == ("C-d,", "e", "f!")


def test_hits_of_folded_words(spark):
    docs = spark.createDataFrame([(1, "Ο λόγος και ο ΛΟΓΟΣ. The oﬃce of the Office", "en")], "doc_id long, text string, lang string")
    found = {q: concordance.Kwic(q).hits(docs).count() for q in ("ΛΌΓΟΣ", "λόγος", "office", "OFFICE of")}
    assert found == {"ΛΌΓΟΣ": 1, "λόγος": 1, "office": 2, "OFFICE of": 1}


@pytest.mark.parametrize("query", ['"in" [] "of"', '[] "terms"', '"of" []', "[]", '[word="t*s"] "of" [pos="X"]', 'starts_with("pol")'])
@pytest.mark.parametrize("scope", ["stream", "sentence"])
def test_hits_in_rows_equal_joins(spark, query, scope):
    docs = spark.createDataFrame([(1, "In terms of policy. In terms of law.", "en"), (2, "in support of policy", "en"), (3, "", "en"), (4, None, "en"), (5, "of", "en")], "doc_id long, text string, lang string")
    columns = ["document_id", "language", "sentence_no", "sentence_position", "stream_position", "token_length", "document_length"]
    slots = parse_brackets(query)
    joined = concordance.phrase_hits(index.token_table(docs), slots, scope=scope).select(*columns).collect()
    rows = concordance.row_hits(docs, slots, scope=scope).select(*columns)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, joined))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_contingency(spark):
    table = Contingency.from_marginals(*map(F.lit, (20, 100, 50, 1000)))
    m = table.measures()
    row = spark.range(1).select(*[c.alias(f"o{i}") for i, c in enumerate(table.observed)], *[c.alias(f"e{i}") for i, c in enumerate(table.expected)], *[c.alias(k) for k, c in m.items()], p_value(F.lit(3.841458820694124)).alias("p")).first()
    assert [row[f"o{i}"] for i in range(4)] == [20, 80, 30, 870] and [row[f"e{i}"] for i in range(4)] == [5, 95, 45, 855]
    assert row["mi"] == 2 and row["mi2"] == pytest.approx(math.log2(80)) and row["mi3"] == pytest.approx(math.log2(1600))
    assert row["dice"] == pytest.approx(40 / 150) and row["mu"] == 4 and row["drf"] == pytest.approx(0.2 - 30 / 900)
    assert row["z_score"] == pytest.approx(15 / math.sqrt(5)) and row["t_score"] == pytest.approx(15 / math.sqrt(20)) and row["minimum_sensitivity"] == 0.2
    assert row["p"] == pytest.approx(0.05)
    assert not spark.range(1).select(Contingency.from_marginals(*map(F.lit, (51, 100, 50, 1000))).valid()).first()[0]


def test_zero_cells(spark):
    table = Contingency.from_marginals(*map(F.lit, (0, 10, 10, 100)))
    row = spark.range(1).select(*[c.alias(k) for k, c in table.measures().items()]).first()
    assert row["mi"] == 0 and row["t_score"] == 0 and row["log_dice"] == 14
    key = spark.range(1).select(*[c.alias(k) for k, c in keyness(*map(F.lit, (5, 100, 0, 100))).items()]).first()
    assert key["log_ratio"] == pytest.approx(math.log2(10))


def test_keywords(tokens):
    good, bad = tokens.where("document_id < 3"), tokens.where("document_id = 3")
    rows = {r["term"]: r for r in lists.keywords(good, bad).collect()}
    assert rows["terms"]["log_ratio"] > 0 and "support" not in rows
    assert "support" in {r["term"] for r in lists.keywords(good, bad, negatives=True).collect()}


def test_cloud_layout_is_free_of_overlaps():
    placed = lists.cloud_layout([(f"word{i}", 50 - i, 40.0 - i / 2) for i in range(30)])
    assert len(placed) > 20 and placed == lists.cloud_layout([(f"word{i}", 50 - i, 40.0 - i / 2) for i in range(30)])


def test_folding_leaves_punctuation_punctuation():
    """So folded words tell whether a run holds punctuation, and runs with it may be left out before they are counted."""
    import sys
    import unicodedata

    marks = lambda t: all(unicodedata.category(c)[0] in "PS" for c in t)
    assert all(marks(chr(i)) == marks(chr(i).casefold()) for i in range(sys.maxunicode + 1))


def test_runs_are_shuffled_once(spark):
    """By term or pattern; repeated ids count as one document, surfaces of the first are shown."""
    texts = [(2, "The old man. THE Old Man! the old man", "en"), (1, "the Old man, the old hat", "en"), (1, "The old man", "en"), (3, None, "en"), (None, "the old man", "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    runs, slots = lists.ngrams(docs, 3), lists.open_slot_ngrams(docs, 3, 3)
    for found in (runs, slots, lists.ngrams(docs, 3, contains="Old")):
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in runs.collect()] == [("the old man", "the old man", 6, 3)]
    row = slots.first()
    assert tuple(row)[:4] == ("the old <*>", 7, 3, 3) and row["entropy"] == pytest.approx(1.148835, abs=1e-6)


def test_collocates_within_documents_that_can_hold_a_hit(spark):
    """The same rows, whether nodes are sought in all documents or in those that hold the word; counts stay those of all."""
    texts = [(1, "The Thing near a hat. A thing, near", "en"), (2, "a hat near nothing", "en"), (3, "a hat", "en"), (4, None, "en"), (5, "THING hat", "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    tokens, held = index.token_table(docs), index.token_table(docs.where("doc_id in (1, 2, 5)"))
    kinds = [sorted(map(tuple, collocation.collocates(tokens, "thing", left=2, right=2, within=w).collect())) for w in (None, held)]
    assert kinds[0] == kinds[1] and {r[0]: r[7] for r in kinds[1]}["hat"] == 4
