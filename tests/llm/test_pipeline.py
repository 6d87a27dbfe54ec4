"""The pipeline's stages on a small table, and what each must leave."""

import hashlib
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from philolog.llm import registry
from philolog.llm.queries_tokens import bpe_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "personal data", "mixing sources", "BPE encoding"]
    assert {re.match(r"op(\d+)_", n)[1] for n in registry.queries()} == {str(n) for n in range(1, 14)}


def test_quality_keeps_clean_documents(spark, steps):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = labels.join(steps[1], "doc_id", "left_semi").groupBy("quality").count().collect()
    counts = dict(map(tuple, kept))
    assert counts.get(0, 0) <= 1 and counts[1] >= labels.where("quality = 1").count() - 1


def test_one_of_each_group_stays(steps):
    texts = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    kept = {r["doc_id"] for r in steps[2].collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    sets = {i: shingles(t) for i, t in texts.items()}
    for i in set(texts) - kept:
        assert any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in texts if j < i) or len(sets[i]) == 0
    ids = sorted(kept)
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k])


def test_near_copies_by_five_words_at_80_percent(spark):
    """Copies with a fifth of their text appended go too, by brute force over shingles of five words."""
    draw = random.Random(9)
    texts = []
    for size in (10, 18, 22, 25, 27, 60):
        base = [f"w{draw.randrange(3000)}" for _ in range(104)]
        texts += [base, base + [f"x{draw.randrange(3000)}" for _ in range(size)]]
    texts.append([*texts[0][:50], "edit", *texts[0][51:]])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    frame = spark.createDataFrame([(i, " ".join(t), "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, FOLDER).collect()}
    assert {i for i, _ in links} == {1, 3, 5, 7, 12} and kept == set(range(len(texts))) - {i for i, _ in links}


def test_columns_and_rows(steps):
    names = steps[0].columns
    assert all(s.columns == names for s in steps[1:5])
    assert steps[3].count() == steps[2].count()
    assert steps[3].where(F.col("text").rlike(r"\S@[A-Za-z0-9-]+\.[a-z]")).count() == 0
    assert steps[5].count() == steps[4].count()


def test_encoded(steps):
    tokenizer = Tokenizer.from_file(bpe_path())
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    for r in steps[5].limit(50).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
