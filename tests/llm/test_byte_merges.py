"""Byte-level BPE by ranks against the library of such vocabularies and a plain version."""

import base64
import hashlib
import random
import struct
import time
import tracemalloc

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from philolog.llm import byte_merges, registry

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n\n  x", "x" * 5000, " " * 3000 + "a", "it's we'll I'M", "漢字かな交じり文" * 40, "🙂👩‍👩‍👧 ½ Ⅷ", " a\x85b\xa0　c", "\x1c\x1d x", "a\x00b", "힣\U0001d7ce\U00010d40Ᲊ", "thethethe" * 400, "===---===" * 50, "<|endoftext|>", "é é"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(ranks, word):
    """One merge at a time, the leftmost of the least rank."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        found = min((ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if found[0] == 1 << 30:
            break
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
    return [ranks[p] for p in parts]


def test_equals_the_library(spark, library):
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice("abcdeth \n'sé漢🙂̀٣½_-.") for _ in range(draw.randint(1, 200))) for _ in range(150)]
    frame = spark.createDataFrame([(k % 7 if k % 5 else None, t, "?", "?") for k, t in enumerate(texts)] + [(1, None, None, None)], "doc_id long, text string, word string, decoded string")
    rows = byte_merges.decode(byte_merges.encode(frame, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(rows) == len(texts) + 1 and all(r["word"] in ("?", None) for r in rows)
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_fold_equals_single_merges(spark):
    """Words folded by Spark, short and long, against one merge at a time."""
    merges, draw = byte_merges.Merges(PATH), random.Random(5)
    words = ["".join(draw.choice("theriano") for _ in range(n)) for n in [1, 2, 3, 5, 8, 13, 60, 63, 64, 65, 130, 400]] + ["a" * n for n in range(1, 140, 7)] + [" " * 90, "Qx" * 60]
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", merges.encoded(F.col("word")).alias("ids")).collect()
    assert all(r["ids"] == plain(merges.ranks.rank_of, r["word"].encode()) for r in rows)


def test_sure_merges_come_before_the_fold(spark):
    """A fold starts from fewer pieces than bytes, with the same encoding."""
    merges, draw = byte_merges.Merges(PATH), random.Random(6)
    words = [" dieenkeitenach", " andthhableea", " ofheaneawh", "Lichch", "aaaaaa", "ße", " "] + ["".join(draw.choice("theriano sé漢🙂-.=") for _ in range(draw.randint(1, 20))) for _ in range(400)]
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", merges.sure_ids(F.col("word")).alias("start"), merges.encoded(F.col("word")).alias("ids")).collect()
    token_of = {rank: token for token, rank in merges.ranks.rank_of.items()}
    assert all(b"".join(token_of[i] for i in r["start"]) == r["word"].encode() and r["ids"] == plain(merges.ranks.rank_of, r["word"].encode()) for r in rows)
    assert sum(len(r["start"]) for r in rows[:4]) < 0.75 * sum(len(r["word"].encode()) for r in rows[:4])


def test_words_folded_once_or_in_place_are_equal(spark, library):
    texts = [f"zorblax quendiv {k % 3} frobnicat" for k in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for share, rows in ((1 << 21, 20_000), (1, 1)):
        assert [r["ids"] for r in byte_merges.encode(frame, PATH, public_tokenizers.PATTERN, sample_rows=rows, share=share).collect()] == [library.encode_ordinary(t) for t in texts]


def test_classes_equal_the_library(spark, library):
    """Every code point between letters is cut as the library cuts it."""
    points = [chr(c) for c in range(1, 0x110000, 17) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x80, 0x3100)]
    texts = ["".join(f"a{c} " for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    found = byte_merges.encode(spark.createDataFrame([(t,) for t in texts], "text string"), PATH, public_tokenizers.PATTERN).collect()
    assert all(r["ids"] == library.encode_ordinary(r["text"]) for r in found)


def test_classes_and_vocabularies_in_little_memory():
    """No objects of all code points at once, and one copy of a vocabulary, read anew when its file changes."""
    tracemalloc.start()
    found = byte_merges._members(r"\p{N}")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ord("½") in found and ord("5") in found and ord("a") not in found and 0x10FFFF not in found and peak < 10e6
    assert sum(map(len, byte_merges._points())) == len(set("".join(byte_merges._points()))) == 0x110000 - 0x800
    assert byte_merges.Merges(PATH).ranks is byte_merges.Merges(PATH).ranks


def test_a_long_run_of_letters(spark):
    """300 KB without any border between words."""
    draw, began = random.Random(1), time.time()
    text = "".join(draw.choice("qjxzvkwy") for _ in range(300_000))
    row = byte_merges.decode(byte_merges.encode(spark.createDataFrame([(text,)], "text string"), PATH, public_tokenizers.PATTERN), PATH).first()
    assert bytes(row["decoded"]).decode() == text and time.time() - began < 60


def test_empty_table_and_odd_ids(spark):
    empty = spark.createDataFrame([], "text string")
    assert byte_merges.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0
    rows = byte_merges.decode(spark.createDataFrame([([1, 99_999],), ([-1],), (None,), ([],)], "ids array<int>"), PATH).collect()
    assert [r["decoded"] for r in rows] == [None, None, None, b""]


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = registry.queries()["op11_byte_bpe"](spark, folder)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = rows.collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
