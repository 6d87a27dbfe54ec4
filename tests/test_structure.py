"""Loosely marked texts: units, tokens and alignments."""

import pytest

from philolog.sources import structure

ZH = """<head>标题/n 一/m</head><p n="1"><s n=1>我们/r 爱/v北京/ns。/w</s><s n='2'>-->他/r 来/v ， 了 /u <g>[NP 12]</s>
<P N="2">没有/v 句/n <p>无号 <s>有/v 句/n《书/n》/w 鹤</p><p>nothing numbered"""
EN = """<p n="1"><s n="1">We_PP love_VV (_( Beijing_NP )_) ._SENT</s><s n="2">He_PP came_VV , ok a_b_NN --> -> <--now_RB
<p n="2">No_DT sentences_NNS<p><s>It_PP has_VHZ !"""


@pytest.fixture(scope="module")
def rows(spark):
    return structure.structured(spark.createDataFrame([("z", "zh", ZH), ("e", "en", EN), ("n", "en", None), ("x", "en", "no marks at all")], "source_id string, language string, text string"))


def of(rows, source):
    return rows.where(f"source_id = '{source}'").orderBy("sentence_no").collect()


def test_chinese(rows):
    found = of(rows, "z")
    assert [(r["paragraph_no"], r["paragraph_number"], r["sentence_no"], r["number"], r["alignable"]) for r in found] == [(1, 1, 1, 1, True), (1, 1, 2, 2, True), (2, 2, 3, None, False), (3, None, 4, None, True)]
    assert [r["sentence"] for r in found] == ["我们爱北京。", "他来，了", "没有句", "有句《书》鹤"]
    assert [(t["word"], t["pos"]) for t in found[0]["tokens"]] == [("我们", "r"), ("爱", "v"), ("北京", "ns"), ("。", "PUNCT")]
    assert [(t["word"], t["pos"]) for t in found[1]["tokens"]] == [("他", "r"), ("来", "v"), ("，", "PUNCT"), ("了", "UNK")]
    assert [(t["word"], t["pos"]) for t in found[3]["tokens"]] == [("有", "v"), ("句", "n"), ("《", "PUNCT"), ("书", "n"), ("》", "PUNCT"), ("鹤", "UNK")]
    assert {r["title"] for r in found} == {"标题一"}


def test_english(rows):
    found = of(rows, "e")
    assert [r["sentence"] for r in found] == ["We love (Beijing).", "He came, ok a_b now", "No sentences", "It has!"]
    assert [(t["word"], t["pos"]) for t in found[1]["tokens"]] == [("He", "PP"), ("came", "VV"), (",", "PUNCT"), ("ok", "UNK"), ("a_b", "NN"), ("now", "RB")]
    for r in found:
        assert all(r["sentence"][t["start"] : t["end"]] == t["word"] for t in r["tokens"])
    assert of(rows, "n") == of(rows, "x") == []


def test_paragraphs(rows):
    found = {(r["source_id"], r["unit_no"]): (r["number"], r["text"]) for r in structure.paragraphs(rows).collect()}
    assert found["e", 1] == (1, "We love (Beijing). He came, ok a_b now") and found["z", 1] == (1, "我们爱北京。他来，了") and found["e", 3] == (None, "It has!")


@pytest.mark.parametrize(
    ("a", "b", "wanted", "method"),
    [
        ([1, 2, 3], [1, 2, 3], [(1, 1), (2, 2), (3, 3)], "provided_structure_id"),
        ([1, 1, 2], [1, 1, 2], [(1, 1), (2, 2), (3, 3)], "provided_structure_order"),
        ([None, None], [None, None], [(1, 1), (2, 2)], "provided_structure_order"),
        ([1, 2, 2, None, 5], [2, 1, 2, 2], [(1, 2), (2, 1), (3, 3)], "provided_structure_id"),
        ([1], [2], [], None),
        ([2, 1], [1, 2], [(1, 2), (2, 1)], "provided_structure_id"),
    ],
)
def test_alignment(spark, a, b, wanted, method):
    units = spark.createDataFrame([(s, k, n, f"{s}{k}") for s, side in (("a", a), ("b", b)) for k, n in enumerate(side, 1)], "source_id string, unit_no int, number long, text string")
    found = structure.aligned(units, spark.createDataFrame([("p", "a", "b")], "pair_id string, a_source string, b_source string")).orderBy("pair_no").collect()
    assert [(r["a_no"], r["b_no"]) for r in found] == wanted and {r["method"] for r in found} == ({method} if wanted else set())
    assert [r["pair_no"] for r in found] == list(range(1, len(wanted) + 1)) and all(r["a_text"] == f"a{r['a_no']}" and r["b_text"] == f"b{r['b_no']}" for r in found)
