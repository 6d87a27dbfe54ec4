"""Chinese words from a lexicon of tagged text, and terms as one token or several."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from philolog.functions import segment
from philolog.functions.segment import Lexicon, learn
from philolog.operators import concordance, index, postings
from philolog.plans.query import Slot
from philolog.sources import importers

TAGGED = "北京/ns 大学/n 的/u 学生/n 在/p 北京/ns 学习/v 汉语/n 。/w\n大学生/n 学习/v 生活/n 很/d 好/a ，/w 北京大学/nt 也/d 好/a 。/w\n研究/v 生命/n 的/u 学生/n 研究生/n 研究/v 生命/n 。/w"


@pytest.fixture(scope="module")
def lexicon(spark):
    words = spark.createDataFrame([(w.rpartition("/")[0],) for w in TAGGED.split()], "surface string")
    return learn(words)


def best_by_trying_all(lexicon, run):
    def score(words):
        return sum(lexicon.logs.get(w, lexicon.unknown if len(w) == 1 else -math.inf) for w in words)

    cuts = itertools.product([False, True], repeat=len(run) - 1)
    return max(score("".join(c + ("|" if b else "") for c, b in zip(run, (*way, False), strict=True)).split("|")) for way in cuts)


def test_paths_are_the_most_probable(lexicon):
    draw = random.Random(1)
    letters = "北京大学生研究命的习汉语活好也鹤"
    for _ in range(200):
        run = "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))
        words = lexicon.cut(run)
        assert "".join(words) == run
        assert math.isclose(sum(lexicon.logs.get(w, lexicon.unknown) for w in words), best_by_trying_all(lexicon, run), abs_tol=1e-9)


def test_words_of_tagged_text(lexicon):
    assert lexicon.words("北京大学的学生研究生命。") == ["北京大学", "的", "学生", "研究", "生命", "。"]
    assert lexicon.words("鹤鹤 Linux北京3.5号") == ["鹤", "鹤", "Linux", "北京", "3.5", "号"]
    assert lexicon.words("") == [] and Lexicon({}).words("汉语") == ["汉", "语"]


def test_learning_counts_all_and_keeps_a_bounded_number(spark, lexicon):
    assert lexicon.longest == 4 and math.isclose(sum(map(math.exp, lexicon.logs.values())), 1) and "。" not in lexicon.logs
    few = learn(spark.createDataFrame([("学",)] * 8 + [("生",)] * 3 + [("命",), (None,), ("abc",)], "surface string"), most=4)
    assert set(few.logs) == {"学", "生"}
    assert learn(spark.createDataFrame([], "surface string")).words("汉语") == ["汉", "语"]


def test_words_from_the_tagged_importer(spark, lexicon):
    """The lexicon is learned from what the importer of tagged text gives."""
    rows = importers.tagged(spark.createDataFrame([(1, "zh", TAGGED)], "source_id long, language string, text string"))
    assert learn(rows.select(F.explode("tokens").alias("t")).select("t.word"), "word").logs == lexicon.logs


def test_long_runs_take_linear_time(lexicon):
    run = "北京大学生" * 20_000
    assert "".join(lexicon.cut(run)) == run


def test_characters(spark):
    row = spark.createDataFrame([("漢字kana's 3.5，鹤",)], "t string").select(segment.characters(F.col("t"))).first()[0]
    assert row == ["漢", "字", "kana's", "3.5", "，", "鹤"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "北京大学的学生。学生在北京大学学习！", "zh"), (2, "大学生学习汉语。", "zh"), (3, "Beijing 北京大学", "en"), (4, None, "zh"), (5, "学习生活", "zh")], "doc_id long, text string, lang string")


def test_terms_whole_and_cut(texts, lexicon):
    """北京大学 is a token; 学生在 is none, so its two words are sought."""
    hits = lambda q, w=lexicon: sorted((r["document_id"], r["stream_position"], r["keyword"]) for r in concordance.chinese_hits(texts, q, w).collect())
    assert hits("北京大学") == [(1, 1, "北京大学"), (1, 7, "北京大学")]
    assert hits("学生在") == [(1, 5, "学生 在")]
    assert hits("学习生活") == [(5, 1, "学习 生活")]
    assert hits("没有") == []
    # without a lexicon a run is one token, which the term as a whole may be
    assert hits("学习生活", None) == [(5, 1, "学习生活")]


def test_the_index_finds_both_forms(texts, lexicon, tmp_path):
    made = postings.build(texts, str(tmp_path), lexicon)
    assert made.chinese("北京大学", lexicon) == [Slot("exact", "北京大学")]
    assert made.chinese("学生在", lexicon) == [Slot("exact", "学生"), Slot("exact", "在")]
    assert sorted(r["document_id"] for r in made.kwic(made.chinese("大学生", lexicon), "zh").collect()) == [2]


def test_token_table(texts, lexicon):
    rows = index.token_table(texts, lexicon=lexicon).where("document_id = 2").orderBy("stream_position").collect()
    assert [r["surface"] for r in rows] == ["大学生", "学习", "汉语", "。"]
    assert index.token_table(texts.where("lang = 'en'"), lexicon=lexicon).collect() == index.token_table(texts.where("lang = 'en'")).collect()
    with pytest.raises(ValueError):
        index.token_table(texts, offsets=True, lexicon=lexicon)


@pytest.mark.parametrize("query", ["北京 大学", "北*", "学生|大学"])
def test_other_queries_stand_as_they_are(query, lexicon):
    assert segment.resolved(query, lexicon, lambda _: pytest.fail("no probe")) == segment.resolved(query, None, None, language="en")
