"""Language-model scoring with a weighted backoff automaton.

Every distinct token of the training texts is counted, and its base probability is
(c + 1) / (N + V + 1). Over that lies a discounted trigram model of all n-grams that occur LEAST_COUNT
times, whatever the corpus's size: a context of one or two words whose continuations were kept is a
state, a kept n-gram is an arc, and the failure arc of a state carries the log10 weight of the next
shorter context.

The arcs' weights are pushed along the failure arcs: what an arc has beyond the way over the failure
arc is its own weight, and a failure arc's weight is put on the n-gram that leads to its state (each
word but the last has a word after it). A text's score is then the sum of the weights of its words,
pairs and triples, so texts meet the model by n-grams. Those with a share of FREQUENT, at most
1 / FREQUENT of each length, are broadcast; all others are asked of parts of the model, each held by one
task, to which their keys travel packed. Filters of fixed size spare most n-grams that cannot be in the
model from being counted one by one, and texts' words and n-grams from being asked for; they err to one
side alone: as they fill, more keys travel and the results stay the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from philolog.llm import _bytes
from philolog.llm._session import checkpoints, stored
from philolog.llm.bloom import Bloom, Frequent, frequent

#: Least share of all training tokens of the words and n-grams that every task holds.
FREQUENT = 2.5e-7
#: Least count of a kept n-gram, and what is taken off its count.
LEAST_COUNT, DISCOUNT = 4, 0.75
#: Tokens of one lane; a lane's n-grams are looked up together.
LANE = 1 << 16
#: Bytes of text that are taken apart at once.
TEXT_BYTES = 1 << 20
#: Entries of a count table that a task holds before it merges them.
HELD = 2_000_000
#: Training tokens for each part of the model that texts ask, and keys that they ask of a part at once, about; the least number of parts.
PART_TOKENS, PACK, LEAST_PARTS = 1 << 23, 1 << 9, 24
#: Bits of a word's place in an n-gram that travels as one number.
PLACE_BITS = 21
#: A text's own values; what texts ask of a part, with the keys of words first.
OWN = ("doc_id", "n_tokens", "known", "base", "gain")
PACKED = "part int, first long, words int, keys binary, rows binary, times binary, doc_id array<long>, n_tokens array<long>, known array<long>, base array<double>, gain array<double>"
END = _bytes.mix(np.array([0xE5D], np.uint64))[0]


def tokens(column: pa.Array):
    """(first row, last row, hashes, offsets) of blocks of texts: their words, each text closed by an end token."""
    for lo, hi, w in _bytes.word_blocks(column, TEXT_BYTES):
        n = np.diff(w.offsets) + 1
        offsets = np.concatenate(([0], np.cumsum(n)))
        out = np.full(offsets[-1], END, np.uint64)
        inner = np.ones(offsets[-1], bool)
        inner[offsets[1:] - 1] = False
        out[inner] = w.hashes
        yield lo, hi, out, offsets


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def counted(batches, keys_of):
    """Rows (key, n) of all keys that keys_of(column) yields, summed within the task."""
    parts, held = [], 0
    for batch in batches:
        for keys in keys_of(batch.column(0)):
            parts.append(np.unique(keys, return_counts=True))
            held += len(parts[-1][0])
            if held > HELD and len(parts) > 1:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield _counts(parts.pop())
                    held = 0
    if parts:
        yield _counts(merged(parts))


def _counts(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], ["key", "n"])


@dataclass
class Table:
    """Sorted hashes with values of each."""

    keys: np.ndarray
    values: tuple[np.ndarray, ...]

    @classmethod
    def of(cls, keys: np.ndarray, *values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return cls(keys[order], tuple(v[order] for v in values))

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for one that isn't held."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = np.empty(len(keys), np.int64)
        for lo in range(0, len(keys), LANE):
            lane = keys[lo : lo + LANE]
            at = np.minimum(np.searchsorted(self.keys, lane), len(self.keys) - 1)
            out[lo : lo + LANE] = np.where(self.keys[at] == lane, at, -1)
        return out


def joined_keys(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Name of the pair of two words, or of the triple of two pairs that overlap."""
    return _bytes.mix(_bytes.mix(x) * np.uint64(0x9E3779B97F4A7C15) + y)


def pairs_of(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of its last token, whether a triple ends there too, name) of all pairs."""
    start = np.zeros(len(h) + 1, bool)
    start[offsets[:-1]] = True
    at = np.flatnonzero(~start[1:-1]) + 1
    return at, ~start[at - 1], joined_keys(h[at - 1], h[at])


def triples_of(at: np.ndarray, long: np.ndarray, key: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Places among the pairs of the second pair of each triple whose pairs are both kept."""
    return np.flatnonzero(long[1:] & kept[1:] & kept[:-1]) + 1


def gram_batches(batches, words: Table, pairs: Frequent, triples: Frequent):
    """Rows (k, x, y, z, n) of the pairs (k = 2, z = 0) that the filter lets pass, and of triples of such pairs (k = 3) that theirs does.

    x, y and z are words: the places of those in `words`, the hashes of others. Where all are places below 2^PLACE_BITS, x has the
    three of them and k is more by 2. Rows are sorted by them, so that they take few bytes.
    """
    parts, held = [], 0

    def merge(parts):
        k, x, y, z, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        _, first, at = np.unique(joined_keys(joined_keys(x, y), z) ^ k.astype(np.uint64), return_index=True, return_inverse=True)
        return k[first], x[first], y[first], z[first], np.bincount(at, n, len(first)).astype(np.int64)

    def rows(part):
        k, x, y, z, n = part
        short = (x | y | z) >> np.uint64(PLACE_BITS) == 0
        k, x = np.where(short, k + 2, k), np.where(short, x << np.uint64(2 * PLACE_BITS) | y << np.uint64(PLACE_BITS) | z, x)
        y, z = np.where(short, np.uint64(0), y), np.where(short, np.uint64(0), z)
        order = np.lexsort((z, y, x, k))
        k, x, y, z, n = (c[order] for c in (k, x, y, z, n))
        return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *(pa.array(c.view(np.int64)) for c in (x, y, z)), pa.array(n)], ["k", "x", "y", "z", "n"])

    for batch in batches:
        for _, _, h, offsets in tokens(batch.column(0)):
            at, long, key = pairs_of(h, offsets)
            kept = pairs.may(key)
            three = triples_of(at, long, key, kept)
            three = at[three[triples.may(joined_keys(key[three - 1], key[three]))]]
            two = at[kept]
            place = words.place(h)
            word = np.where(place >= 0, place.view(np.uint64), h)
            x, y = np.concatenate((word[two - 1], word[three - 2])), np.concatenate((word[two], word[three - 1]))
            z = np.concatenate((np.zeros(len(two), np.uint64), word[three]))
            k = np.repeat(np.array([2, 3], np.int8), [len(two), len(three)])
            parts.append(merge([(k, x, y, z, np.ones(len(k), np.int64))]))
            held += len(parts[-1][0])
            if held > HELD // 4 and len(parts) > 1:
                parts = [merge(parts)]
                held = len(parts[0][0])
                if held > HELD // 8:
                    yield rows(parts.pop())
                    held = 0
    if parts:
        yield rows(merge(parts))


def named(batches, words: Table):
    """Rows (k, x, y, n, key) of kept n-grams, by names: of a pair by those of its words, of a triple by those of its pairs."""
    for b in batches:
        k, x, y, z = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "x", "y", "z"))
        x, y, z = (c.view(np.uint64) for c in (x, y, z))
        short, low = k > 3, np.uint64((1 << PLACE_BITS) - 1)
        y, z = np.where(short, x >> np.uint64(PLACE_BITS) & low, y), np.where(short, x & low, z)
        k, x = np.where(short, k - 2, k), np.where(short, x >> np.uint64(2 * PLACE_BITS), x)
        x, y, z = (_hashes(c, words) for c in (x, y, z))
        triple, first = k == 3, joined_keys(x, y)
        x, y = np.where(triple, first, x), np.where(triple, joined_keys(y, z), y)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *(pa.array(c.view(np.int64)) for c in (x, y)), b.column("n"), pa.array(joined_keys(x, y).view(np.int64))], ["k", "x", "y", "n", "key"])


def _hashes(word: np.ndarray, words: Table) -> np.ndarray:
    if not len(words.keys):
        return word
    at = np.minimum(word, np.uint64(len(words.keys) - 1))
    return np.where(at == word, words.keys[at.astype(np.int64)], word)


def _model(grams: DataFrame, counts: DataFrame, total: int, types: int) -> DataFrame:
    """(k, key, c, gain) of all words and kept n-grams: length, name, count, weight beyond the base."""
    over = F.lit(float(total + types + 1))
    two, three = grams.where("k = 2"), grams.where("k = 3")
    left = two.groupBy(F.col("x").alias("key")).agg(F.sum(F.col("n") - DISCOUNT).alias("s"))
    words = counts.join(left.hint("merge"), "key", "left").withColumn("left", 1 - F.col("s") / F.col("c")).select("key", "c", "left")
    of_first = words.where("left is not null").select(F.col("key").alias("x"), F.col("c").alias("c_x"), "left")
    of_last = counts.select(F.col("key").alias("y"), ((F.col("c") + 1) / over).alias("base"))
    p = (F.col("n") - DISCOUNT) / F.col("c_x") + F.col("left") * F.col("base")
    two = two.join(of_first.hint("merge"), "x").join(of_last.hint("merge"), "y").select("key", "n", p.alias("p"), (F.log10(p) - F.log10("base") - F.log10("left")).alias("gain"))
    # both pairs of a kept triple are as frequent as it is, and so are kept too
    rest = three.groupBy(F.col("x").alias("key")).agg(F.sum(F.col("n") - DISCOUNT).alias("s"))
    two = two.join(rest.hint("merge"), "key", "left").withColumn("rest", 1 - F.col("s") / F.col("n")).select("key", "n", "p", "gain", "rest")
    two = stored(two)
    before = two.where("rest is not null").select(F.col("key").alias("x"), F.col("n").alias("n_x"), "rest")
    lower = two.select(F.col("key").alias("y"), "p")
    p = (F.col("n") - DISCOUNT) / F.col("n_x") + F.col("rest") * F.col("p")
    three = three.join(before.hint("merge"), "x").join(lower.hint("merge"), "y").select(F.lit(3).alias("k"), "key", F.col("n").alias("c"), (F.log10(p) - F.log10("p") - F.log10("rest")).alias("gain"))
    return stored(
        words.select(F.lit(1).alias("k"), "key", "c", F.coalesce(F.log10("left"), F.lit(0.0)).alias("gain"))
        .unionByName(two.select(F.lit(2).alias("k"), "key", F.col("n").alias("c"), (F.col("gain") + F.coalesce(F.log10("rest"), F.lit(0.0))).alias("gain")))
        .unionByName(three)
    )


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) with how often each occurs."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]))) if len(keys) else np.zeros(0, bool))
    return rows[first], keys[first], np.diff(np.concatenate((first, [len(keys)])))


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their lowest bytes first, then their second ones and so on: small or rising numbers take few bytes when compressed."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.int64) % parts


def packs(found, parts: int):
    """Rows of PACKED, of what texts ask of each part of the model; texts' own values go with one of them.

    found: for runs of texts in order (first row, their own columns, of sorted distinct words and then n-grams the rows, keys and times).
    Some runs go together, so that a part is asked for PACK keys at once, about.
    """
    held, size = [], 0
    for one in found:
        held.append(one)
        size += len(one[2][1]) + len(one[3][1])
        if size >= parts * PACK:
            yield _packed(held, parts)
            held, size = [], 0
    if held:
        yield _packed(held, parts)


def _packed(held: list, parts: int) -> pa.RecordBatch:
    first, n = held[0][0], sum(len(x[1][0]) for x in held)
    asked = [(w, x) for w in (2, 3) for x in held]
    rows, keys, times = (np.concatenate([x[w][k] for w, x in asked]) for k in range(3))
    words = sum(len(x[2][1]) for x in held)
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    rows, keys, times, at = rows[order] - first, keys[order], times[order], np.searchsorted(part[order], np.arange(parts + 1))
    of_words = np.bincount(part[:words], minlength=parts)
    home = int(_bytes.mix(np.array([first], np.uint64))[0] % np.uint64(parts))
    used = [p for p in range(parts) if p == home or at[p] < at[p + 1]]
    cut = [slice(at[p], at[p + 1]) for p in used]
    offsets = pa.array(np.concatenate(([0], np.where(np.array(used) < home, 0, n))), pa.int32())
    own = [pa.ListArray.from_arrays(offsets, pa.concat_arrays([x[1][k] for x in held])) for k in range(5)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array([first] * len(used), pa.int64()),
            pa.array(of_words[used].astype(np.int32)),
            pa.array([keys[c].tobytes() for c in cut], pa.binary()),
            pa.array([_planes(rows[c]) for c in cut], pa.binary()),
            pa.array([_planes(times[c]) for c in cut], pa.binary()),
            *own,
        ],
        ["part", "first", "words", "keys", "rows", "times", *OWN],
    )


def answered(asked: pa.Table, model: pa.Table, over: float) -> pa.Table:
    """Sums (row, doc_id, n_tokens, known, base, gain) for the texts that ask a part of the model, and the own values that came along."""
    table = Table.of(model["key"].to_numpy().view(np.uint64), model["c"].to_numpy(), model["gain"].to_numpy())
    rows, keys, times, word, own_rows = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    columns = (asked[c].to_pylist() for c in ("first", "words", "keys", "rows", "times"))
    sizes = np.diff(asked["doc_id"].combine_chunks().offsets.to_numpy()) if asked.num_rows else ()
    for first, words, k, r, t, n in zip(*columns, sizes, strict=True):
        keys.append(np.frombuffer(k, np.uint64))
        rows.append(_from_planes(r).astype(np.int64) + first)
        times.append(_from_planes(t).astype(np.int64))
        word.append(np.arange(len(keys[-1])) < words)
        own_rows.append(first + np.arange(n))
    rows, keys, times, word, own_rows = (np.concatenate(x) for x in (rows, keys, times, word, own_rows))
    at = table.place(keys)
    hit = at >= 0
    count, gain = np.zeros(len(keys), np.int64), np.zeros(len(keys))
    count[hit], gain[hit] = table.values[0][at[hit]], table.values[1][at[hit]]
    ids, of = np.unique(rows, return_inverse=True)
    sums = [np.bincount(of, times * x, len(ids)) for x in (word & (count > 0), np.where(word, np.log10((count + 1) / over), 0.0), gain)]
    none = pa.nulls(len(ids), pa.int64())
    own = [asked[c].combine_chunks().flatten() for c in OWN]
    made = [none, none, pa.array(sums[0].astype(np.int64)), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64())]
    return pa.table([pa.array(np.concatenate((ids, own_rows))), *(pa.concat_arrays([x, y]) for x, y in zip(made, own, strict=True))], ["row", *OWN])


def score_texts(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10).

    Rows for which the column `learn` is true are learned from. A null text is empty: it has the end
    token alone. Ids may be null or repeated; rows are told apart by their place in the input. With
    nothing to learn from, N and V are 0 and every token has probability 1.
    """
    spark = docs.sparkSession
    checkpoints(spark)
    source = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"))
    train = source.where("learn").select("text")
    counts = train.mapInArrow(lambda b: counted(b, lambda c: (h for _, _, h, _ in tokens(c))), "key long, n long")
    counts = counts.groupBy("key").agg(F.sum("n").alias("c")).checkpoint()
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    context = spark.sparkContext

    def all_grams(column: pa.Array):
        for _, _, h, offsets in tokens(column):
            at, long, key = pairs_of(h, offsets)
            three = triples_of(at, long, key, np.ones(len(key), bool))
            yield key, joined_keys(key[three - 1], key[three])

    # at most 1 / FREQUENT of each length come to the driver
    least = max(FREQUENT * total, 2)
    short = context.broadcast(Table.of(counts.where(F.col("c") >= least).select("key").toArrow()["key"].to_numpy().view(np.uint64)))
    kept = context.broadcast(frequent(train, all_grams, 2, LEAST_COUNT, HELD))
    grams = train.mapInArrow(lambda b: gram_batches(b, short.value, *kept.value), "k int, x long, y long, z long, n long")
    grams = grams.groupBy("k", "x", "y", "z").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    grams = stored(grams).mapInArrow(lambda b: named(b, short.value), "k int, x long, y long, n long, key long")
    weights = _model(grams, counts, total, types)
    top = weights.where(F.col("c") >= least).toArrow()
    hashes, is_word = top["key"].to_numpy().view(np.uint64), top["k"].to_numpy() == 1
    count, gain = top["c"].to_numpy(), top["gain"].to_numpy()
    words = Table.of(hashes[is_word], np.log10((count[is_word] + 1) / (total + types + 1)), gain[is_word])
    # a word of held-out texts alone is seldom asked for, however often it occurs
    model = context.broadcast((words, Table.of(hashes[~is_word], gain[~is_word]), Bloom.of(grams.select("key")), Bloom.of(counts.select("key"))))
    over, parts = float(total + types + 1), max(LEAST_PARTS, total // PART_TOKENS)
    unseen = math.log10(1 / over)

    def run(batches):
        words, often, bloom, word_bloom = model.value
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, h, offsets in tokens(batch.column(0)):
                n, rank = hi - lo, words.place(h)
                row = np.repeat(np.arange(n), np.diff(offsets))
                seen = rank >= 0
                base = np.bincount(row[seen], words.values[0][rank[seen]], n).astype(float)
                gain = np.bincount(row[seen], words.values[1][rank[seen]], n).astype(float)
                known = np.bincount(row[seen], minlength=n)
                new = np.flatnonzero(~seen)
                may = word_bloom.may(h[new])
                base += unseen * np.bincount(row[new[~may]], minlength=n)
                new = new[may]
                at, long, key = pairs_of(h, offsets)
                may = bloom.may(key)
                three = triples_of(at, long, key, may)
                names = joined_keys(key[three - 1], key[three])
                also = bloom.may(names)
                names, owner = np.concatenate((key[may], names[also])), np.concatenate((row[at[may]], row[at[three[also]]]))
                found = often.place(names)
                hit = found >= 0
                gain += np.bincount(owner[hit], often.values[0][found[hit]], n)
                own = [batch.column(1).slice(lo, n), pa.array(np.diff(offsets)), pa.array(known.astype(np.int64)), pa.array(base, pa.float64()), pa.array(gain, pa.float64())]
                yield place, own, *((place + of, *rest) for of, *rest in (_distinct(row[new], h[new]), _distinct(owner[~hit], names[~hit])))
                place += n

    asked = source.select("text", "doc_id").mapInArrow(lambda b: packs(run(b), parts), PACKED)
    part = F.pmod(F.shiftrightunsigned("key", 32), F.lit(parts)).cast("int")
    rare = weights.where(F.col("c") < least).select(part.alias("part"), "key", "c", "gain")
    found = asked.groupBy("part").cogroup(rare.groupBy("part")).applyInArrow(lambda a, m: answered(a, m, over), "row long, doc_id long, n_tokens long, known long, base double, gain double")
    return (
        found.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("gain").alias("gain"))
        .select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))
    )
