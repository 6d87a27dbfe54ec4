"""Vectors of chunks over several runs."""

import sys

import pytest
from pyspark import cloudpickle

from philolog.operators import embedding, neighbours
from philolog.operators.embedding import EmbeddingError, HashedWords, refresh
from philolog.sources import versions


# workers cannot import tests
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counted(HashedWords):
    """Leaves a file for each text that it embeds."""

    def embed(self, texts):
        import os
        import uuid

        assert 0 < len(texts) <= 3
        for _ in texts:
            open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        return super().embed(texts)


def counted(folder, **options):
    made = Counted(**options)
    object.__setattr__(made, "folder", str(folder))
    return made


@pytest.fixture
def asked(tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    return folder


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string, extra string")


def test_only_what_is_new_or_changed_is_embedded(spark, tmp_path, asked):
    folder, provider = str(tmp_path / "v"), counted(asked)
    rows = [(f"c{k}", f"text number {k}", None) for k in range(10)] + [("n", None, "x"), ("e", "", "x")]
    count = lambda: len(list(asked.iterdir()))
    first = refresh(frame(spark, rows), folder, provider, batch=3)
    assert (first.embedded, first.kept, first.dropped, count()) == (12, 0, 0, 12)
    again = refresh(frame(spark, rows), folder, provider, batch=3)
    assert (again.version, again.embedded, again.kept, count()) == (first.version, 0, 12, 12)
    changed = [("c0", "another text", None), *rows[2:], ("new", "a new one", None)]
    third = refresh(frame(spark, changed), folder, provider, batch=3)
    assert (third.embedded, third.kept, third.dropped) == (2, 10, 2) and count() == 14
    assert third.version.number == 2 and third.version.rows == {"vectors": 12}
    stored = {r["chunk_id"]: r["vector"] for r in embedding.vectors(spark, folder).collect()}
    assert set(stored) == {c for c, *_ in changed}
    assert stored["c0"] == pytest.approx(HashedWords().embed(["another text"])[0], abs=1e-6)


def test_another_provider_embeds_all(spark, tmp_path, asked):
    folder = str(tmp_path / "v")
    rows = frame(spark, [("a", "x", None), ("b", "y", None)])
    refresh(rows, folder, counted(asked), batch=3)
    other = refresh(rows, folder, counted(asked, name="other", dim=16), batch=3)
    assert (other.embedded, other.kept) == (2, 0) and {len(r["vector"]) for r in embedding.vectors(spark, folder).collect()} == {16}


class Short(HashedWords):
    def embed(self, texts):
        return super().embed(texts)[1:]


class Zero(HashedWords):
    def embed(self, texts):
        return [[0.0] * self.dim for _ in texts]


@pytest.mark.parametrize("provider", [Short(), Zero()])
def test_bad_vectors_are_not_published(spark, tmp_path, provider):
    """The version before stays; what was written is gone."""
    folder = str(tmp_path / "v")
    first = refresh(frame(spark, [("a", "x", None)]), folder, HashedWords())
    with pytest.raises(Exception, match="vectors"):
        refresh(frame(spark, [("a", "x", None), ("b", "y", None)]), folder, provider)
    assert versions.current(spark, folder) == first.version
    assert len(list((tmp_path / "v" / "versions").iterdir())) == 1


def test_repeated_ids_and_no_chunks(spark, tmp_path):
    for rows in ([("a", "x", None), ("a", "y", None)], [(None, "x", None)]):
        with pytest.raises(EmbeddingError):
            refresh(frame(spark, rows), str(tmp_path / "v"), HashedWords())
    assert refresh(frame(spark, []), str(tmp_path / "w"), HashedWords()).version.rows == {"vectors": 0}


def test_vectors_go_into_the_neighbour_index(spark, tmp_path):
    """Chunks of like words are neighbours."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) as chunk_id", "text", "lang")
    refresh(docs, str(tmp_path / "v"), HashedWords())
    rows = embedding.vectors(spark, str(tmp_path / "v")).selectExpr("cast(chunk_id as long) as vec_id", "vector as embedding")
    found = neighbours.build(rows, str(tmp_path / "i")).search(rows, 3, others=True)
    langs = {int(r["chunk_id"]): r["lang"] for r in docs.select("chunk_id", "lang").collect()}
    pairs = [(langs[r["query_id"]], langs[r["id"]]) for r in found.collect()]
    known = [(a, b) for a, b in pairs if a and b]
    assert sum(a == b for a, b in known) > 0.7 * len(known)
