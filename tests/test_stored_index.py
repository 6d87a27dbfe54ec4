"""Published versions, and queries from the stored positional index against those over texts."""

import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from philolog.operators import collocation, concordance, index, postings
from philolog.plans.query import QueryError, Slot, parse_brackets, parse_simple
from philolog.sources import versions
from tests.test_catalogue import duck, plain  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
ROWS = [(1, "The thing. Of the thing, the Thing of it! The end", "en"), (2, None, "en"), (3, "", "en"), (4, "of the of the of. The", "en"), (5, "die Of the", "de"), (6, "the " * 3000, "en"), (6, "of the", "en"), (None, "of the", None)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def made(texts, tmp_path_factory):
    return postings.build(texts, str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("query", ["of the", "the", "thing", "th*", "?he|of", "missing", "of the of the of", ["of", "[]", "of"], ["[]", "the"], ["the", "[]", "[]"], [Slot("exact", "The", case_sensitive=True)], [Slot("exact", "of"), Slot("full", "T.*", case_sensitive=True)], [Slot("ends", "g"), Slot("any")]])
def test_kwic_equals_texts(texts, made, query):
    if isinstance(query, list) and isinstance(query[0], str):
        query = parse_brackets(" ".join(query))
    distinct = texts.where("doc_id != 6")
    columns = ["document_id", "sentence_no", "stream_position", "token_length", "left_context", "keyword", "right_context"]
    slots = parse_simple(query) if isinstance(query, str) else query
    want = concordance.row_hits(distinct.where("lang = 'en'"), slots, width=5).select(*columns).collect()
    got = made.kwic(query).where("document_id != 6").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_lists_equal_texts(texts, made):
    tokens = index.token_table(texts.where("lang = 'en'"))
    from philolog.operators import lists

    assert sorted(map(tuple, made.word_list().drop("document_range").collect())) == sorted(map(tuple, lists.word_list(tokens).drop("document_range").collect()))
    want = collocation.collocates(tokens.where("document_id != 6"), "thing", left=2, right=3)
    few = postings.build(texts.where("doc_id != 6"), made.version.folder + "-few").collocates("thing", left=2, right=3)
    strip = lambda rows: sorted(tuple(plain(v) for v in r) for r in rows.collect())
    assert strip(few.select(want.columns)) == strip(want)


def test_the_term_reaches_the_scan(made):
    """Only the postings of the query's terms are read, and no positions for lists."""
    plan = made.positions("of the")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,of)" in plan and "EqualTo(term,the)" in plan
    plan = made.word_list()._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan and "surfaces" not in plan


def test_what_the_index_lacks(made):
    for slots in ([Slot("any")], [Slot("exact", "NN", "pos")]):
        with pytest.raises(QueryError):
            made.kwic(slots)


@pytest.mark.parametrize("name", ["index_phrase", "index_wildcards", "index_collocates", "index_word_list", "index_plot_bins", "collocates_significance"])
def test_against_sql(spark, duck, name):  # noqa: F811
    rows = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(rows.columns)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert own == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_an_empty_corpus(spark, tmp_path):
    empty = postings.build(spark.createDataFrame([], "doc_id long, text string, lang string"), str(tmp_path))
    assert empty.version.rows == {"words": 0, "postings": 0, "terms": 0}


def test_readers_never_meet_a_gap(spark, tmp_path):
    """A reader in a loop during 20 publications sees whole versions, in order."""
    folder, seen, failed, done = str(tmp_path), [], [], threading.Event()
    last = versions.publish({"t": spark.range(1)}, folder)

    def read():
        while not done.is_set():
            try:
                now = versions.current(spark, folder)
                seen.append((now.number, now.table(spark, "t").count()))
            except Exception as problem:
                failed.append(problem)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 22):
        last = versions.publish({"t": spark.range(n)}, folder, after=last, keep=6)
    done.set()
    reader.join()
    assert not failed and seen == sorted(seen) and all(a == b for a, b in seen) and versions.current(spark, folder).number == 21


def test_of_two_writers_one_wins(spark, tmp_path):
    folder = str(tmp_path)
    first = versions.publish({"t": spark.range(1)}, folder)
    won, lost = [], []

    def write(n):
        try:
            won.append(versions.publish({"t": spark.range(n)}, folder, after=first))
        except versions.Conflict as problem:
            lost.append(problem)

    writers = [threading.Thread(target=write, args=(n,)) for n in (5, 7)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == len(lost) == 1 and versions.current(spark, folder) == won[0]
    assert won[0].table(spark, "t").count() == won[0].rows["t"]


def test_a_manifest_that_was_not_finished_is_passed_over(spark, tmp_path):
    folder = str(tmp_path)
    first = versions.publish({"t": spark.range(3)}, folder)
    (tmp_path / "manifests" / "000000000002.json").write_bytes(b'{"number": 2')
    assert versions.current(spark, folder) == first
    assert versions.publish({"t": spark.range(4)}, folder, after=first).number == 3
    assert versions.current(spark, folder).rows == {"t": 4}


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    folder = str(tmp_path)
    first = versions.publish({"t": spark.range(3)}, folder)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        versions.publish({"t": spark.range(3).select((1 / F.col("id")).alias("x")), "u": spark.range(3).select(F.expr("1 / (id - id)").alias("x"))}, folder, after=first)
    assert versions.current(spark, folder) == first


def test_a_table_made_from_the_one_before(spark, tmp_path):
    """Terms are counted from the postings as they were written, so texts are not cut for them."""
    made = versions.publish({"t": spark.range(5), "u": lambda written: written["t"].where("id > 2")}, str(tmp_path))
    assert made.rows == {"t": 5, "u": 2} and made.table(spark, "u").count() == 2


def test_postings_of_documents_in_portions(monkeypatch):
    """Documents dealt over portions, some without words, give the runs that a plain loop finds."""
    import pyarrow as pa

    words = [["b", "a", "b"], [], None, ["é", "a", "a"], ["z"] * 5, []]
    surfaces = [["B", "a", "b"], [], None, ["É", "A", "a"], ["z", "Z", "z", "z", "Z"], []]
    batch = pa.RecordBatch.from_pydict({"document_id": [1, 2, 3, None, 5, 6], "language": ["en", "en", "en", None, "de", "de"], "surfaces": surfaces, "words": words})
    want = []
    for k, (number, language) in enumerate(zip(batch["document_id"].to_pylist(), batch["language"].to_pylist(), strict=True)):
        for term in sorted(set(words[k] or [])):
            at = [i for i, w in enumerate(words[k]) if w == term]
            own = [surfaces[k][i] for i in at]
            want.append((language, term, number, len(at), min(own), list(dict.fromkeys(own)), [i + 1 for i in at]))
    for portion in (1, 4, 100):
        monkeypatch.setattr(postings, "TOKENS_AT_ONCE", portion)
        got = [tuple(r.values()) for b in postings._runs(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
