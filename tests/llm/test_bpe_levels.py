"""BPE by levels of the trie, against the walk word by word, the pattern and the library."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from philolog.llm import bpe, bpe_levels
from philolog.llm.queries_tokens import bpe_path

LETTERS = ["abé ß'stlmdrev\n\t 1²\x1c\x85 漢🙂.-_ĠİA᠎ 　", "'sletrvmd \n", "0123456789 ,.-\n  ", "<|endoftext|> a'"]


@pytest.fixture(scope="module")
def walker():
    return bpe_levels.Walker(bpe_path())


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def walked(walker, words):
    ranks, at = walker.tokens(pa.array(words, pa.binary()))
    ids = walker.ids[ranks].tolist()
    return [ids[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def test_levels_and_words_walk_alike(walker):
    draw = random.Random(1)
    words = sorted({"".join(draw.choice(["th", "on", "é", "ung", "x", "Q", "7", "chr", "漢"]) for _ in range(draw.randint(1, 9))).encode() for _ in range(5000)} | {b"a" * 200, b"ab" * 500, bytes(range(256))})
    assert walked(walker, words) == [list(ids) for _, ids in bpe.Bpe(bpe_path()).walk(words)]


def test_rare_words_are_walked_together(walker):
    """Words of which hardly any token or prefix repeats take a part of the time that they take one by one."""
    draw = random.Random(2)
    words = sorted({" " + "".join(draw.choice("etaoinshrdlucmfwyp") for _ in range(draw.randint(6, 16))) for _ in range(60_000)})
    words = [w.encode() for w in words]
    plain = bpe.Bpe(bpe_path())
    list(plain.walk([b"a"]))
    began = time.process_time()
    wanted = [list(ids) for _, ids in plain.walk(words)]
    middle = time.process_time()
    found = walked(walker, words)
    assert found == wanted and time.process_time() - middle < (middle - began) / 2


@pytest.mark.parametrize("letters", LETTERS)
def test_starts_are_those_of_the_pattern(letters):
    draw = random.Random(letters)
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([0, *map(len, texts)])
    edge = np.zeros(len(points) + 1, bool)
    edge[ends] = True
    wanted = [lo + m.start() for lo, t in zip(ends, texts, strict=False) for m in bpe.PRETOKEN.finditer(t)]
    assert np.flatnonzero(bpe_levels.starts(points, edge)).tolist() == wanted


@pytest.mark.parametrize("letters", LETTERS)
def test_blocks_equal_the_library(walker, letters):
    tokenizer = Tokenizer.from_file(bpe_path())
    draw = random.Random(letters)
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(500)] + ["", "<|endoftext|>'s<|endoftext|>", "<|endo", "ftext|>", " " * 300, "漢字" * 300]
    n, of_ids, of_text, ids, decoded = bpe_levels.columns(walker, *block(texts), ("ids", "decoded"))
    wanted = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.to_pylist() == wanted and n.tolist() == list(map(len, wanted)) and decoded == texts
    assert of_ids == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in wanted]
    assert of_text == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


@pytest.mark.parametrize("whole", [60, 1 << 20])
def test_long_texts_by_parts(walker, monkeypatch, whole):
    """Parts of a few bytes, and runs without a border that are too long for arrays, change nothing."""
    monkeypatch.setattr(bpe_levels, "BLOCK_BYTES", 50)
    monkeypatch.setattr(bpe_levels, "WHOLE", whole)
    tokenizer = Tokenizer.from_file(bpe_path())
    for text in ["a b  c\n d " * 30, "one<|endoftext|> two <|endoftext|>three " * 9, "é漢🙂 " * 40, "x" * 90, " " * 80, "　 x 　" * 40, "a b" * 20 + "y" * 100]:
        [n], [of_ids], [of_text], [ids], [decoded] = bpe_levels.columns(walker, *block([text]), ("ids", "decoded"))
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted and n == len(wanted) and decoded == text
        assert of_ids == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest() and of_text == hashlib.sha256(text.encode()).hexdigest()
    assert len(list(bpe_levels.parts(walker, b"ab cd " * 40))) > 3


def test_known_pairs_are_bounded(walker, monkeypatch):
    monkeypatch.setattr(bpe_levels, "KEPT_PAIRS", 50)
    draw = random.Random(3)
    own = bpe_levels.Walker(bpe_path())
    words = pa.array(sorted({"".join(draw.choice("abcdefgh") for _ in range(8)).encode() for _ in range(500)}), pa.binary())
    assert [x.tolist() for x in own.tokens(words)] == [x.tolist() for x in walker.tokens(words)] and own.known.size <= 50
