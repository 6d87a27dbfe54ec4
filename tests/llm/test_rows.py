"""Rows with null ids, one id for all, and one id over unlike texts."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from philolog.llm import language, mixing, quality, shingle_join

SCHEMA = "doc_id long, text string, lang string, source string, row string, place string"


def text(draw, words, n=30):
    return " ".join(draw.choice(words) + draw.choice("abcdefgh") for _ in range(n))


@pytest.mark.parametrize("of", [lambda k: None, lambda k: 4, lambda k: k % 3])
def test_language_samples_rows(spark, of, monkeypatch):
    """Each language is learned though ids tell no rows apart."""
    monkeypatch.setattr(language, "ROWS_PER_LANGUAGE", 100)
    draw = random.Random(1)
    rows = [(of(k), text(draw, ["the", "thing"]) if k % 2 else text(draw, ["der", "ung"]), "en" if k % 2 else "de", None, None, None) for k in range(10_000)]
    model = language.fit(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    assert model.languages == ["de", "en"] and len(model.names) < 10_000


def test_near_duplicates_go_by_rows(spark):
    """A near copy goes though its id has another row; a row goes with its group, whatever else it holds."""
    draw = random.Random(2)
    a, b, c = (text(draw, ["lorem", "ipsum", "dolor"], 40) for _ in range(3))
    rows = [(3, a, "en", "x", "1", None), (5, a + " more", "en", "x", "2", None), (5, b, "en", "x", "3", None), (None, b + " more", None, None, None, None), (None, c, "en", "p", None, None), (None, c, "en", "q", None, None), (7, None, None, None, None, None), (7, None, None, None, None, "z")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), "").collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted([("3", a), ("5", b), ("None", c), ("7", ""), ("7", "")])
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "row", "place"}


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 9])
def test_repeated_rows_send_their_set_once(spark, ids, monkeypatch):
    """3,000 equal rows and a near copy: a tile gets each set once from each task."""
    draw = random.Random(3)
    a = text(draw, ["lorem", "ipsum"], 60)
    frame = spark.createDataFrame([(ids(k), a, None, None, None, None) for k in range(3000)] + [(1, a + " more", None, None, None, None)], SCHEMA).repartition(4)
    sent = []
    real = shingle_join._with_sets
    monkeypatch.setattr(shingle_join, "_with_sets", lambda *x: sent.append(real(*x)) or sent[-1])
    found = shingle_join.shingle_groups(frame).collect()
    assert len(found) == 3001 and {r["component_id"] for r in found} == {1} and sent[0].count() <= 2 * 4


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 4])
def test_mixing_parts_hold_few_rows(spark, ids):
    """Rows of one id are dealt by their texts too; targets are met."""
    draw = random.Random(4)
    rows = [(ids(k), text(draw, ["a", "b"], 1 + k % 7), None, f"s{k % 2}", None, None) for k in range(10_000)]
    mix = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), texts=False).taken
    for r in mix.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 1


def test_quality_sample_is_bounded(spark, monkeypatch):
    """A labelled id that most rows bear brings no more of them than the sample's bound."""
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 300)
    draw = random.Random(5)
    rows = [(k % 20 if k < 1000 else 0, text(draw, ["good", "text"] if k % 2 else ["!!", "##"], 20), None, None, None, None) for k in range(9000)]
    seen = []
    real = quality.described
    monkeypatch.setattr(quality, "described", lambda frame, *a: seen.append(frame) or real(frame, *a))
    quality.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int"))
    assert 300 < seen[0].count() < 900
