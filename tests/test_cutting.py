"""Texts cut in Arrow against the expressions on columns, and what is merged as they are cut."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from philolog.functions import cutting
from philolog.functions import text as X
from philolog.operators import index, postings

TEXTS = [
    "The thing. Of the thing, the Thing of it! The end", None, "", " \u3000 ", '我们。你好！ok? "yes." ’ no.”) go', "Straße ΟΔΟΣ ǰoe İstanbul ﬁsh 𐐀𐐁 don’t e.g. 1,000.5 ½ Ⅳ x²  a\x85b c\x1cd é 😀😀 _a_ \x00 $+ ﷺ",
    "a.\"  b!) c?' d.' e", "...'  \n\n ok. . .", "𐐀 and 𝟘𝟙 Ⱥ",
]
ROWS = [(i % 8 if i else None, t, language) for i, (t, language) in enumerate((t, x) for x in ("en", "zh", None) for t in TEXTS)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(2)


def same(got, want):
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


@pytest.mark.parametrize("at_once", [1, 30, 10**6])
def test_sentences_and_tokens_equal_expressions(spark, texts, at_once, monkeypatch):
    cut = X.sentences(F.coalesce("text", F.lit("")), F.col("lang"))
    want = texts.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("language"), F.posexplode(cut).alias("i", "sentence")).withColumn("tokens", X.tokens(F.col("sentence")))
    got = index.sentence_table(texts)
    same(got.select("document_id", "language", (F.col("sentence_no") - 1).cast("int").alias("i"), "sentence", "tokens"), want)
    offsets = index.token_table(texts, offsets=True)  # by expressions
    same(index.token_table(texts), offsets)
    # the same rows, however many letters are cut at once
    monkeypatch.setattr(cutting, "LETTERS_AT_ONCE", at_once)
    batch = texts.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("language"), "text").toArrow().combine_chunks().to_batches()[0]
    names = ["document_id", "language", "stream_position", "surface", "normalized", "is_punctuation"]
    own = [tuple(r.values()) for b in cutting.cutter("token", names)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert sorted(own, key=repr) == sorted(map(tuple, offsets.select(names).collect()), key=repr)


def test_postings_of_documents_share_rows(spark, texts):
    """A term has a row for some documents, not one for each: what is shuffled and sorted grew with terms times documents."""
    got = postings.of_texts(texts.coalesce(1))
    rows = got.collect()
    assert len(rows) == len({(r["language"], r["term"]) for r in rows}) < sum(r["document_range"] for r in rows)
    want, shown = Counter(), {}
    for t in index.token_table(texts, offsets=True).collect():
        want[t["language"], t["normalized"], t["document_id"], t["stream_position"]] += 1
        shown.setdefault((t["language"], t["normalized"]), set()).add(t["surface"])
    found = Counter((r["language"], r["term"], d, p) for r in rows for d, at in zip(r["document_ids"], r["positions"], strict=True) for p in at)
    assert found == want
    for r in rows:
        mine = sorted(shown[r["language"], r["term"]], key=str.encode)
        assert (r["display"], r["surfaces"], r["frequency"]) == (mine[0], mine, sum(map(len, r["positions"])))


def test_many_distinct_words(spark):
    """Codes of words by codes of surfaces go beyond 32 bits."""
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(70_000))
    rows = postings.of_texts(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"))
    assert rows.agg(F.count(F.lit(1)), F.sum("frequency"), F.sum(F.size("surfaces"))).first()[:] == (70_000, 70_000, 70_000)
