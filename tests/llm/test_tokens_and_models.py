"""Language, language models, BPE, media and quality against plain versions."""

import hashlib
import io
import math
import random
import re
import tracemalloc
import wave
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from philolog.llm import _bytes, automaton, bloom, bpe, language, media, quality, unigram
from philolog.llm.queries_tokens import bpe_path

SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, " \n\t ", None, None), (3, "x" * 300_000, "en", "s"), (4, "漢字 🙂 ½", "en", None), (5, "1 2 3 ...", "de", "t")]


def words_of(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(4)
    vocabulary = {"en": "the of and thing there with".split(), "fr": "le la les des eau aux".split()}
    rows = []
    for i in range(300):
        lang = draw.choice(["en", "fr"])
        stems = [w + s for w in vocabulary[lang] for s in ("", "", draw.choice("abcdefgh"), draw.choice("xyz") * 2)]
        rows.append((i + 10, " ".join(draw.choice(stems) for _ in range(draw.randint(1, 80))) + draw.choice([".", "\n", "  "]), lang, f"s{i % 3}"))
    return rows


def clash(frame):
    """Columns named like those that operators use themselves."""
    return frame.select("*", *[F.lit("?").alias(c) for c in ("score", "node", "n", "row", "key", "id", "size", "email", "src", "tile")])


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_tables_pass_through(spark, rows):
    frame = clash(spark.createDataFrame(rows, SCHEMA))
    n = len(rows)
    assert language.predict(frame, language.fit(frame, F.col("doc_id") > 0)).count() == n
    assert automaton.score_texts(frame, F.col("doc_id") > 0).count() == n
    assert automaton.score_texts(frame, F.lit(False)).count() == n
    assert bpe.encode_decode(frame, bpe_path()).count() == n
    assert unigram.count_tokens(frame, bpe_path()).count() == n
    assert media.to_wav(frame).count() == n
    labels = spark.createDataFrame([(1, 1), (3, 0)][: len(rows)], "doc_id long, quality int")
    scored = quality.score(frame.withColumn("_words", F.lit("?")), quality.fit(frame, labels))
    assert all(0 <= r["score"] <= 1 and r["_words"] == r["node"] == "?" for r in scored.collect()) and scored.count() == n


def test_language(spark, corpus):
    frame = spark.createDataFrame(corpus + ODD, SCHEMA)
    found = language.predict(frame, language.fit(frame, F.col("doc_id") % 2 == 0)).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert sum(by_id[i]["lang_pred"] == lang for i, _, lang, _ in corpus) >= 295
    assert [by_id[i]["lang_pred"] for i in (None, 1, 2, 5)] == ["und"] * 4 and by_id[4]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in found)


def test_backoff_falls_to_shorter_grams():
    rows = [(lang, language.name_of(n, entry), share) for n, entry, *shares in [(0, "word", 0.5, 0.1), (4, " wor", 0.3, 0.2), (2, "zz", 0.01, 0.4), (1, "q", 0.2, 0.1)] for lang, share in zip("ab", shares, strict=True)]
    found = language.Model.of(["a", "b"], rows).score(["word", "worx", "zz", "qq", "j"])
    assert found == pytest.approx(np.log(np.array([[0.5, 0.1], [0.3, 0.2], [0.01, 0.4], [0.2, 0.1], [1 - 1e-6, 1 - 1e-6]]) + 1e-6))


def test_language_equals_dictionaries(spark, corpus):
    """Model and prediction by dictionaries, word by word; ties go to the first language."""
    odd = [(2000, "½ Ⅷ İX ǅ 12 straße", "de", "s"), (2001, "zzzz qqqq", "en", "s"), (2002, "", "fr", "s"), (2003, None, "fr", "s"), (2004, "the le", None, "s"), (None, "the thing", "en", "s"), (2000, "again 1", "en", "s")]
    rows = corpus[:200] + odd
    frame = spark.createDataFrame(rows, SCHEMA)
    cut = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    tables, totals = {}, Counter()
    for i, t, lang, _ in rows:
        if i is not None and i % 4 != 2 and lang and t is not None:
            for w in cut(t):
                for n, entries in [(0, [w]), *((n, language.grams(w, n)) for n in language.LENGTHS)]:
                    for e in entries:
                        tables.setdefault((n, e), Counter())[lang] += 1
                        totals[lang, n] += 1
    languages = sorted({lang for lang, _ in totals})

    def log(n, e):
        return [math.log(tables[n, e][k] / totals[k, n] + language.UNSEEN) for k in languages]

    def word(w):
        if (0, w) in tables:
            return log(0, w)
        for n in language.LENGTHS:
            if known := [log(n, g) for g in language.grams(w, n) if (n, g) in tables]:
                return np.mean(known, 0)
        return np.zeros(len(languages))

    def wanted(t):
        if not (words := cut(t)):
            return "und", 0.0
        sums = np.sum([word(w) for w in words], 0)
        return languages[int(sums.argmax())], 1 / np.exp(sums - sums.max()).sum()

    found = language.predict(frame, language.fit(frame, F.col("doc_id") % 4 != 2)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6))
    expected = sorted([(i, *wanted(t)) for i, t, *_ in rows], key=key)
    for own, right in zip(sorted(map(tuple, found), key=key), expected, strict=True):
        assert own[:2] == right[:2] and own[2] == pytest.approx(right[2], rel=1e-6)


def test_language_model_comes_as_numbers(spark):
    """The driver's Python holds numbers for each entry of the model, no objects."""
    draw = random.Random(8)
    texts = [" ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(300)) for _ in range(100)]
    frame = spark.createDataFrame([(i, t, ("en", "de")[i % 2], "s") for i, t in enumerate(texts)], SCHEMA)
    tracemalloc.start()
    model = language.fit(frame, F.lit(True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.names) > 150_000 and peak < 130 * len(model.names)


def brute_lm(train, texts):
    """Base and model scores, token by token, with dictionaries."""
    c, c2, c3 = Counter(), Counter(), Counter()
    for t in train:
        w = [*words_of(t), 0]
        c.update(w)
        c2.update(zip(w, w[1:], strict=False))
        c3.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c.values()), len(c)
    base = lambda x: math.log10((c[x] + 1) / (n + v + 1))
    p2 = {g: k for g, k in c2.items() if k >= automaton.LEAST_COUNT}
    p3 = {g: k for g, k in c3.items() if k >= automaton.LEAST_COUNT}
    d = automaton.DISCOUNT
    left2, left3 = Counter(), Counter()
    for (a, _), k in p2.items():
        left2[a] += (k - d) / c[a]
    for (a, b, _), k in p3.items():
        left3[a, b] += (k - d) / c2[a, b]

    def two(a, x):
        if a not in left2:
            return 10 ** base(x)
        return (p2[a, x] - d) / c[a] * ((a, x) in p2) + (1 - left2[a]) * 10 ** base(x) if (a, x) in p2 else (1 - left2[a]) * 10 ** base(x)

    def three(a, b, x):
        if (a, b) not in left3:
            return two(b, x)
        own = (p3[a, b, x] - d) / c2[a, b] if (a, b, x) in p3 else 0
        return own + (1 - left3[a, b]) * two(b, x)

    out = []
    for t in texts:
        w = [*words_of(t), 0]
        s = sum(math.log10(three(w[i - 2], w[i - 1], w[i]) if i > 1 else two(w[i - 1], w[i]) if i else 10 ** base(w[i])) for i in range(len(w)))
        out.append((len(w), sum(c[x] > 0 for x in w), n, sum(map(base, w)), s))
    return out


def test_automaton_equals_dictionaries(spark, corpus, monkeypatch):
    monkeypatch.setattr(automaton, "LANE", 16)
    corpus = corpus + [(1000, "the of " * 900, "en", "s")]
    frame = spark.createDataFrame(corpus, SCHEMA)
    scored = {r["doc_id"]: r for r in automaton.score_texts(frame, F.col("doc_id") % 7 != 2).collect()}
    wanted = brute_lm([t for i, t, *_ in corpus if i % 7 != 2], [t for _, t, *_ in corpus])
    better = 0
    for (i, *_), (n, known, total, base, score) in zip(corpus, wanted, strict=True):
        r = scored[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
        better += score > base
    assert better > len(corpus) / 2


@pytest.mark.parametrize("frequent", [2e-6, 2e-3, 1.0])
def test_seldom_ngrams_are_kept_in_large_corpora(spark, monkeypatch, frequent):
    """A phrase said five times is in the model however many other tokens there are, broadcast or joined."""
    monkeypatch.setattr(automaton, "FREQUENT", frequent)
    draw = random.Random(12)
    texts = ["blue moon rising"] * 5 + [" ".join(draw.choice("abcdefgh") for _ in range(400)) for _ in range(300)] + ["blue moon a", "moon rising unseen", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    scored = {r["doc_id"]: r for r in automaton.score_texts(frame, F.col("doc_id") < 305).collect()}
    for i, (n, known, total, base, score) in enumerate(brute_lm(texts[:305], texts)):
        r = scored[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("bits", [21, 2])
def test_ngrams_of_common_words_travel_as_one_number(monkeypatch, bits):
    """They get back the names of their words; so do those with words that have no place, or a high one."""
    monkeypatch.setattr(automaton, "PLACE_BITS", bits)
    draw = random.Random(2)
    texts = pa.array([" ".join(draw.choice("abcdefgh") for _ in range(200)) for _ in range(20)])
    ((_, _, h, offsets),) = automaton.tokens(texts)
    words = automaton.Table.of(np.unique(h)[:6])
    every = bloom.Frequent(np.full(1 << bloom.BLOOM_BITS - 3, 255, np.uint8), 1)
    rows = list(automaton.gram_batches([pa.record_batch([texts], ["text"])], words, every, every))
    assert bits == 2 or sum((b["k"].to_numpy() > 3).sum() for b in rows) > 150
    found = {(k, x, y, key): n for b in automaton.named(rows, words) for k, x, y, n, key in zip(*(b[c].to_pylist() for c in ("k", "x", "y", "n", "key")), strict=True)}
    at, long, key = automaton.pairs_of(h, offsets)
    three = automaton.triples_of(at, long, key, np.ones(len(key), bool))
    wanted = Counter(zip([2] * len(at), h[at - 1].view(np.int64).tolist(), h[at].view(np.int64).tolist(), key.view(np.int64).tolist(), strict=True))
    names = automaton.joined_keys(key[three - 1], key[three])
    wanted.update(zip([3] * len(three), *(c.view(np.int64).tolist() for c in (key[three - 1], key[three], names)), strict=True))
    assert found == wanted


def test_keys_travel_packed():
    """Each key takes little more than its own eight bytes on its way to the model, and all of them meet what they ask for."""
    draw = np.random.default_rng(3)
    made, model = [], draw.integers(0, 2**64, 40_000, dtype=np.uint64)
    for k in range(40):
        own = [pa.array([None, *range(49)], pa.int64()), *(pa.array(np.full(50, k), pa.int64()) for _ in range(2)), *(pa.array(np.zeros(50)) for _ in range(2))]
        lists = []
        for keys in (model[:10_000], model[10_000:]):
            rows = np.sort(draw.integers(0, 50, 1000)) + 50 * k
            lists.append((rows, draw.choice(keys, 1000), draw.integers(1, 3, 1000)))
        made.append((50 * k, own, *lists))
    table = pa.Table.from_batches(list(automaton.packs(iter(made), 8)))
    size = sum(len(pa.compress(b"".join(table[c].to_pylist()), "lz4", asbytes=True)) for c in ("keys", "rows", "times"))
    assert table.num_rows < 400 and size < 11 * 80_000
    weights = pa.table({"key": model.view(np.int64), "c": np.arange(40_000), "gain": np.arange(40_000) / 7})
    gain, words, own = np.zeros(2000), np.zeros(2000), 0
    for part in range(8):
        mine = pa.array(automaton.part_of(model, 8) == part)
        out = automaton.answered(table.filter(pa.array(table["part"].to_numpy() == part)), weights.filter(mine), 10.0).to_pandas()
        own += out["n_tokens"].notna().sum()
        gain += np.bincount(out["row"], out["gain"], 2000)
        words += np.bincount(out["row"], out["base"], 2000)
    place = automaton.Table.of(model, np.arange(40_000))
    for column, lists in ((gain, (2, 3)), (words, (2,))):
        wanted = np.zeros(2000)
        for x in made:
            for w in lists:
                at = place.values[0][place.place(x[w][1])]
                np.add.at(wanted, x[w][0], x[w][2] * (at / 7 if column is gain else np.log10((at + 1) / 10)))
        assert column == pytest.approx(wanted)
    assert own == 2000


def test_frequent_keys_pass(spark, monkeypatch):
    """All keys that occur often enough pass, few others do, however the counts are cut into parts."""
    draw = np.random.default_rng(5)
    keys = draw.integers(0, 2**64, 3000, dtype=np.uint64)
    times = draw.integers(1, 9, 3000)
    rows = np.repeat(keys, times)
    draw.shuffle(rows)
    frame = spark.createDataFrame([(r.tobytes(),) for r in np.array_split(rows, 40)], "raw binary").repartition(3)
    own, none = bloom.frequent(frame, lambda c: ((np.frombuffer(x, np.uint64), np.zeros(0, np.uint64)) for x in c.to_pylist()), 2, 4, 500)
    assert (own.may(keys) == (times >= 4)).mean() > 0.99 and own.may(keys[times >= 4]).all()
    assert not none.may(keys).any()


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    draw = random.Random(9)
    letters = "abé ß'stl\n\t 1²\x1c\x85 漢🙂.-_ĠİA᠎ "
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    texts += ["<|endoftext|>a <|endoftext|>", "it's I'LL  'sx", "", "x" * 20_000, "internationalization antidisestablishmentarianism " * 50, "aaaa" * 3000]
    tokenizer = Tokenizer.from_file(bpe_path())
    rows = bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bpe_path()).collect()
    for r in rows:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False) == texts[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_long_texts_in_parts(spark, monkeypatch):
    """Blocks of a few bytes and parts of a few characters change nothing."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe_path())
    own = bpe.Encoder(bpe.Bpe(bpe_path()))
    monkeypatch.setattr(bpe, "PART", 7)
    for text in ["", "a b  c\n d " * 30, "one<|endoftext|> two <|endoftext|>three " * 9, "é漢🙂 " * 40, "x" * 90, " " * 50]:
        parts = [own.encode([p]) for p in own.parts(text)]
        n, of_ids, of_text, ids, decoded = bpe.digests(own, (i for p in own.parts(text) for i in own.encode([p])), ("ids", "decoded"))
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted and n == len(wanted) and decoded == text and len(parts) > (len(text) > 40 and " " in text.strip())
        assert of_ids == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest() and of_text == hashlib.sha256(text.encode()).hexdigest()


def test_words_of_very_long_texts():
    """100 MB with and without blanks: the words are right, and what is held beside the text stays small."""
    import tracemalloc

    for text in (b"some Word " * 10_000_000, b"x" * 100_000_000):
        data = np.frombuffer(text, np.uint8)
        tracemalloc.start()
        found = _bytes.words(data, np.array([0, len(data)]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        small = _bytes.words(data[:10], np.array([0, 10]))
        assert len(found.hashes) == (20_000_000 if b" " in text else 1) and found.offsets.tolist() == [0, len(found.hashes)]
        assert most < 24 * len(found.hashes) + (16 << 20) and (b" " not in text or found.hashes[-2:].tolist() == small.hashes.tolist())


@pytest.mark.parametrize("window", [1, 2, 5, 64])
def test_words_cut_by_windows(monkeypatch, window):
    draw = random.Random(window)
    texts = [bytes(draw.choice(b"aBcd  \n\t") for _ in range(draw.randint(0, 30))) for _ in range(200)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = _bytes.words(data, offsets)
    monkeypatch.setattr(_bytes, "WINDOW", window)
    cut = _bytes.words(data, offsets)
    assert cut.offsets.tolist() == whole.offsets.tolist() and cut.hashes.tolist() == whole.hashes.tolist()
    assert np.diff(whole.offsets).tolist() == [len(t.split()) for t in texts]


def test_kept_words_are_bounded():
    kept = bpe.Kept(3)
    for i in range(20):
        kept.room()
        for k in kept.missing({i, 0}):
            kept.young[k] = k
    assert 0 in kept.young and len(kept.young) + len(kept.old) <= 9


def test_media_round_trip(spark):
    texts = [None, "", "abc", "é" * 96, "a sentence of sounds " * 400]
    rows = media.to_wav(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192) if raw else b" " * 192
        with wave.open(io.BytesIO(r["media"])) as f:
            assert f.readframes(f.getnframes()) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(r["media"]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert list(r["pairs"]) == sorted(r["pairs"])
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["feature"] == by_id[1]["feature"] != by_id[4]["feature"]


def plain_pairs(samples):
    """Peak pairs frame by frame and band by band."""
    frames = [[(x - 128) * (0.5 - 0.5 * math.cos(2 * math.pi * i / 191)) for i, x in enumerate(samples[at : at + 192])] for at in range(0, len(samples), 192)]
    bins = range(1, 97)
    tables = np.exp(-2j * np.pi * np.outer(np.arange(97), np.arange(192)) / 192)
    power = [np.abs(tables @ np.array(f)) for f in frames]
    best = []
    for p in power:
        low, row = 1, []
        for high in media.BANDS:
            k = max((b for b in bins if low <= b < high), key=lambda b, p=p: p[b])
            row.append((p[k], k))
            low = high
        best.append(row)
    peaks = [(t, best[t][b][1]) for t in range(len(best)) for b in range(len(media.BANDS)) if (t == 0 or best[t][b][0] > best[t - 1][b][0]) and (t + 1 == len(best) or best[t][b][0] >= best[t + 1][b][0])]
    return sorted(t << 32 | k << 20 | peaks[i + s][1] << 8 | peaks[i + s][0] - t for i, (t, k) in enumerate(peaks) for s in range(1, media.FAN_OUT + 1) if i + s < len(peaks) and peaks[i + s][0] - t <= media.REACH)


def test_fingerprint_equals_plain_transform():
    draw = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        samples = draw.integers(32, 127, 192 * n).astype(np.uint8)
        found = media.fingerprint(samples).tolist()
        wanted = plain_pairs(samples.tolist())
        # single precision may choose another of two bins that are all but equal
        assert len(set(found) ^ set(wanted)) <= 0.02 * len(wanted) and len(found) == len(wanted)


def test_fingerprints_survive_a_shift():
    draw = np.random.default_rng(1)
    sound = draw.integers(0, 255, 192 * 200).astype(np.uint8)
    later = np.concatenate((draw.integers(0, 255, 192 * 30).astype(np.uint8), sound))
    own, moved = media.fingerprint(sound), media.fingerprint(later)
    assert len(np.intersect1d(own + (30 << 32), moved)) > 0.9 * len(own)


def test_quality_rules(spark):
    draw = random.Random(2)
    good = [" ".join(draw.choice(["thing", "there", "with", "other", "words"]) + draw.choice(["", "er", "ing"]) for _ in range(60)) for _ in range(150)]
    bad = [draw.choice(["SPAM!! " * 40, "x | y | z | " * 20, "$$$ ### word*** " * 15]) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")]
    labels = [(i, int(i < 150)) for i in range(300) if i % 3 != 1] + [(900, 1), (5, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = {r["doc_id"]: r for r in quality.score(frame, model).collect()}
    assert all((found[i]["predicted"] == 1) == (i < 150) for i in range(300) if i % 3 == 1)
    assert 0 < len(model.rules) < 60 and all(0 <= r["score"] <= 1 for r in found.values())


def plain_statistics(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    n, many = max(len(t), 1), max(len(words), 1)
    share = lambda p: len(regex.findall(p, t)) / n
    return [round(x, 6) for x in (
        math.log1p(len(words)), len(t) / many, len(set(words)) / many, share(r"\p{L}"), share(r"\p{Lu}"), share("[0-9]"), share(r"[^\p{L}\p{N}\s.,]"), share("[.,]"), share("!"), share(r"\|"), share("\n"),
        share(r"[{}<>=;#$%&*_\\/]"), float(bool(re.search("licen[sc]e|copyright|all rights reserved", t, re.I))),
    )]


def test_quality_scores_equal_plain_rules(spark, corpus):
    """Statistics, rules and weights by hand give each row's score, and the weights meet the lasso's conditions."""
    texts = [t for _, t, *_ in corpus[:150]] + ["SPAM!! | $5 " * k for k in range(1, 60)] + ["", None, "All Rights Reserved\n{x}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(209) if i % 4], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    x = np.array([plain_statistics(t) for t in texts])
    margin = np.full(len(x), model.bias)
    for rule, weight in model.rules:
        margin += weight * rule.holds(x)
    found = {r["doc_id"]: r["score"] for r in quality.score(frame, model).collect()}
    assert [found[i] for i in range(len(texts))] == pytest.approx((1 / (1 + np.exp(-margin))).tolist(), abs=1e-9)
    draw = np.random.default_rng(1)
    z, y = (draw.random((300, 12)) < 0.4).astype(float), (draw.random(300) < 0.6).astype(float)
    z[:, 0] = y
    bias, w = quality.lasso(z, y)
    error = 1 / (1 + np.exp(-(z @ w + bias))) - y
    slope = z.T @ error / len(y)
    assert abs(error.mean()) < 1e-3 and (np.abs(slope) <= quality.PENALTY + 1e-3).all()
    assert np.allclose(slope[w != 0], -quality.PENALTY * np.sign(w[w != 0]), atol=1e-3) and w[0] > 1


def test_rules_hold_alike_in_both_forms(spark):
    rule = quality.Rule(((0, True, 1.0), (1, False, 2.0)))
    x = np.array([[1.0, 3.0], [2.0, 3.0], [0.0, 2.0]])
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double").select("i", F.struct("a", "b").alias("s"))
    assert rule.holds(x).tolist() == [r[0] for r in rows.select(rule.column(["a", "b"], F.col("s"))).collect()] == [True, False, False]


def test_unigram_counts_equal_plain_dynamic_programming(spark):
    vocabulary = bpe.Bpe(bpe_path())
    value = unigram.log_probabilities(len(vocabulary.rank_of))
    draw = random.Random(11)
    texts = ["".join(draw.choice(["th", "ing", "er", " ", ". ", "é", "漢", "7", "\n", "Q"]) for _ in range(draw.randint(0, 30))) for _ in range(300)] + ["x" * 3000, "", None, "<|endoftext|> a"]

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best.append(max((best[start][0] + value[rank], best[start][1] - 1) for start in range(end) if (rank := vocabulary.rank_of.get(word[start:end])) is not None))
        return -best[-1][1], best[-1][0]

    for r in unigram.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bpe_path()).collect():
        text = texts[r["doc_id"]] or ""
        parts = text.split("<|endoftext|>")
        each = [plain(w.encode()) for p in parts for w in bpe.PRETOKEN.findall(p)]
        assert r["n_tokens"] == sum(n for n, _ in each) + len(parts) - 1
        assert r["log_probability"] == pytest.approx(sum(s for _, s in each))
