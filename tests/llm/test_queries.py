"""The registered queries on the smallest tables: columns, rows and who is held out, as their contracts say."""

import zlib

import pytest
from pyspark.sql import functions as F

from philolog.llm import registry

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_token_counts": ["doc_id", "n_tokens", "log_probability"],
    "op3_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op5_bpe_encoding": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_mixing_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pairs"],
    "op10_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
}
HELD_OUT = {"op1_language_id": (4, 2), "op3_lm_scoring": (7, 2), "op10_quality_classifier": (3, 1)}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    rows = registry.queries()[name](spark, FOLDER)
    assert rows.columns == COLUMNS[name]
    ids = sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    found = rows.drop("pairs").collect()
    assert sorted(r["doc_id"] for r in found) == ids
    if name in HELD_OUT:
        of, rest = HELD_OUT[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % of == rest) for r in found)


def test_vectors_contract(spark):
    rows = registry.queries()["op9_embedding_near_dedup"](spark, FOLDER)
    assert rows.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert rows.count() == spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()


def test_mixed_blocks_meet_the_targets(spark):
    """The texts of op6_mixed_blocks hold the words that op6_mixing_sources says are taken."""
    taken = registry.queries()["op6_mixing_sources"](spark, FOLDER).agg(F.sum("taken")).first()[0]
    blocks = registry.queries()["op6_mixed_blocks"](spark, FOLDER)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    assert blocks.agg(F.sum("n_words"), F.sum(words)).first() == (taken, taken)


@pytest.mark.parametrize("name", ["op1_language_id", "op3_lm_scoring", "op5_bpe_encoding", "op8_media_columns", "op2_token_counts"])
def test_equal_texts_have_equal_values(spark, tmp_path, name):
    """Rows with null, repeated or very different ids get what their text alone gives."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "the thing of it", "en", "s", 15), (3, "the thing of it", "en", "s", 15), (3, "the thing of it", "en", "s", 15), (3, None, None, None, None), (-5, "", None, None, 0)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()[name](spark, str(tmp_path)).collect()
    values = [c for c in rows[0].asDict() if c not in ("doc_id", "held_out")]
    same = {tuple(str(r[c]) for c in values) for r in rows if r["doc_id"] is None or r["doc_id"] == 3}
    assert len(rows) == 65 and sum(r["doc_id"] == 3 for r in rows) >= 3 and len(same) <= 2 + sum(r["doc_id"] == 3 for r in rows) - 3
