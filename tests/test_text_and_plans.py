import hashlib

import pytest
from pyspark.sql import functions as F

from philolog.functions import text as X
from philolog.plans.query import QueryError, Slot, parse_brackets, parse_simple
from philolog.sources import importers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, X.tokens(F.lit("Café—state-of-the-art, China's 3.14%！"))) == ["Café", "—", "state-of-the-art", ",", "China's", "3.14", "%", "！"]
    assert one(spark, X.tokens(F.lit("    "))) == []


def test_sentences_and_paragraphs(spark):
    assert one(spark, X.sentences(F.lit('He said "no." Then\nleft!  Why? '), F.lit("en"))) == ['He said "no.', "Then left!", "Why?"]
    assert one(spark, X.sentences(F.lit("一。二！三"), F.lit("zh"))) == ["一。", "二！", "三"]
    assert one(spark, X.paragraphs(F.lit("a\r\nb\r\n \r\n\r\nc"))) == ["a\nb", "c"]


def test_running_sums(spark):
    data = list(range(1000))
    assert one(spark, X.running(F.lit(data).cast("array<long>"))) == [sum(data[:i]) for i in range(1000)]


@pytest.mark.parametrize(("word", "stem"), [("policies", "policy"), ("boxes", "box"), ("churches", "church"), ("cats", "cat"), ("this", "this"), ("class", "class"), ("bus", "bus"), ("ties", "tie")])
def test_stems(spark, word, stem):
    assert one(spark, X.light_stem(F.lit(word))) == stem


def test_chunks_lose_nothing(spark):
    text = "word, " * 900
    parts = one(spark, X.chunks(F.lit(text)))
    assert all(len(p) <= 1801 for p in parts) and " ".join(parts).replace(" ", "") == text.replace(" ", "")
    assert one(spark, X.chunks(F.lit("x" * 4000))) == ["x" * 1800, "x" * 1800, "x" * 400] and one(spark, X.chunks(F.lit(""))) == []
    assert one(spark, X.chunks(F.lit("ab cd。ef  gh, ij"), 6)) == ["ab cd。", "ef gh,", "ij"]
    assert one(spark, X.chunks(F.lit("a bcdefghijkl"), 6)) == ["a bcde", "fghijk", "l"]


def test_folding_is_full(spark):
    words = ["ΛΌΓΟΣ", "λόγος", "oﬃce", "STRASSE", "Straße", "Ꭰꭰ", "İı", "ŉ", "plain ABC", "", "ΐ"]
    assert [one(spark, X.casefold(F.lit(w))) for w in words] == [w.casefold() for w in words]


def test_sentences_keep_their_figures(spark):
    assert one(spark, X.sentences(F.lit("0 is 0. 1 and 1. 2"), F.lit("en"))) == ["0 is 0.", "1 and 1.", "2"]


def test_literal_spans():
    assert X.literal_spans("Straße STRASSE", "strasse", False, False) == [(0, 6), (7, 14)]
    assert X.literal_spans("then the", "the", False, True) == [(5, 8)]
    assert X.literal_spans("aaa", "aa", True, False) == [(0, 2)]


def test_highlights():
    assert X.highlight_fragments("abcd", ["bc", "b"]) == [{"text": "a", "matched": False}, {"text": "bc", "matched": True}, {"text": "d", "matched": False}]


def test_spreadsheet_guard(spark):
    assert [one(spark, X.spreadsheet_safe(F.lit(x))) for x in ("=1", "a=1", "@x")] == ["'=1", "a=1", "'@x"]


def test_bracket_queries():
    assert parse_brackets('"a B" [] [pos="N*"] starts_with(ab) x*y') == [Slot("exact", "a"), Slot("exact", "b"), Slot("any"), Slot("wildcard", "N*", "pos"), Slot("starts", "ab"), Slot("wildcard", "x*y")]
    for bad in ("", '"a', "[word=a]", '[word="a]"]', "a)b", "*", "x" * 501, "nofunc(a)", '"a"b'):
        with pytest.raises(QueryError):
            parse_brackets(bad)


def test_simple_queries():
    assert parse_simple("The cat") == [Slot("exact", "the"), Slot("exact", "cat")]
    assert parse_simple("th* a|b") == [Slot("full", "th.*"), Slot("full", "(?:a|b)")]
    assert parse_simple("Th", whole_words=False, case_sensitive=True) == [Slot("contains", "Th", case_sensitive=True)]
    for bad in ("", "*", "(", " ".join("a" * 21)):
        with pytest.raises(QueryError):
            parse_simple(bad, regular=bad == "(")


def test_ids_titles_and_highlights(spark):
    frame = spark.createDataFrame([(1, "\n  A title \nThe thing is a Thing", "x"), (2, None, "y")], "n long, t string, k string")
    rows = frame.select(X.stable_id("pair", F.col("n"), F.col("k")).alias("id"), importers.title_of(F.col("t")).alias("title"), X.highlighted(F.col("t"), ["thing", "the thing"]).alias("parts")).collect()
    assert rows[0]["id"] == "pair-" + hashlib.sha256(b"1:x").hexdigest()[:32] and rows[0]["id"] != rows[1]["id"]
    assert [r["title"] for r in rows] == ["A title", ""]
    assert [(p["text"], p["matched"]) for p in rows[0]["parts"]] == [("\n  A title \n", False), ("The thing", True), (" is a ", False), ("Thing", True)] and rows[1]["parts"] == []
