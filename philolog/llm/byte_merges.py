"""Byte-level BPE encoding and decoding by Spark's higher-order functions alone.

A word's bytes become an array of token ids (what is sure to be merged before all that could touch it
already as one), which a fold turns into its encoding: each step finds
the pair of neighbours whose bytes together have the least rank, by a literal map from pairs to ranks,
and merges it. Words that make up a large enough share of a corpus are folded once, as distinct words,
and held in a literal map beside the vocabulary's own words; the rest are folded where they stand.
Decoding concatenates the ids' pieces.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Callable
from functools import cached_property, lru_cache

import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from philolog.llm._memory import give_back
from philolog.llm._session import stored

#: Rows whose words are counted to choose those that are folded once: words that make up 1 / SHARE of all, so at most SHARE.
SAMPLE_ROWS, SHARE = 20_000, 1 << 21
#: Bytes of the longest word that the literal map of words holds; from this size on a word is cut before it is folded.
WORD_BYTES = 64
#: Primes: rows of the literal map of pairs, shifted to lie over each other without clashes, and their length; cells of the map of words.
SHIFTS, ROW, WORD_CELLS = 32_749, 200_003, 131_071
#: Tokens of the least ranks that a pattern joins before a word is folded, and cells of their map.
SURE, SURE_CELLS = 512, 8191
#: A pair's key is its first id above RANK_BITS bits of its second; from NONE on a number is no rank.
RANK_BITS = 20
NONE = 1 << RANK_BITS
#: Ids that mark a finished fold, and a token that its left neighbour has taken in.
DONE, GONE = -1, -2
#: Fixed: the code points that count as white space in Unicode, as a class of Java's patterns.
WHITE = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


class Ranks:
    """A vocabulary file of ranks: a token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank_of = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        missing = [b for b in range(256) if bytes([b]) not in self.rank_of]
        if missing or max(self.rank_of.values()) >= NONE:
            raise ValueError(f"{path} is no byte-level vocabulary")
        self.byte_ids = [self.rank_of[bytes([b])] for b in range(256)]

    def pieces(self) -> list[str | None]:
        """By id, the token's bytes as hexadecimal digits."""
        out: list[str | None] = [None] * (max(self.rank_of.values()) + 1)
        for token, rank in self.rank_of.items():
            out[rank] = token.hex()
        return out

    def pair_table(self) -> tuple[list[int], list[int]]:
        """Shifts by key modulo SHIFTS, and by key modulo ROW and its shift an entry: the key of a pair above the rank of the pair's bytes together."""
        rows: dict[int, dict[int, int]] = {}
        for token, rank in self.rank_of.items():
            for k in range(1, len(token)):
                a, b = self.rank_of.get(token[:k]), self.rank_of.get(token[k:])
                if a is not None and b is not None:
                    key = (a << RANK_BITS) + b
                    row = rows.setdefault(key % SHIFTS, {})
                    if key % ROW in row:
                        raise ValueError("two pairs of the vocabulary share a place; choose another ROW")
                    row[key % ROW] = (key << RANK_BITS) + rank
        shifts, table = [0] * SHIFTS, [0] * (2 * ROW)
        for at, row in sorted(rows.items(), key=lambda x: -len(x[1])):
            while any(table[place + shifts[at]] for place in row):
                shifts[at] += 1
            for place, entry in row.items():
                table[place + shifts[at]] = entry
        return shifts, table[: ROW + max(shifts)]

    def joined_bytes(self) -> list[list[int]]:
        """By the id of a single byte, the ids of the single bytes that follow it inside any token."""
        found: dict[int, set[int]] = {}
        for token in self.rank_of:
            for x, y in zip(token, token[1:], strict=False):
                found.setdefault(x, set()).add(y)
        out: list[list[int]] = [[] for _ in range(max(self.byte_ids) + 1)]
        for x, ys in found.items():
            out[self.byte_ids[x]] = sorted(self.byte_ids[y] for y in ys)
        return out

    def crossing(self) -> list[list[int]]:
        """By two bytes that stand side by side, the least rank of all tokens that hold both so: no merge of a lesser rank joins them."""
        least = [[NONE] * 256 for _ in range(256)]
        for token, rank in self.rank_of.items():
            for x, y in zip(token, token[1:], strict=False):
                least[x][y] = min(least[x][y], rank)
        return least

    def greatest_merge(self, token: bytes) -> int:
        """The greatest rank of the merges that make a token of its bytes; NONE if they do not."""
        parts, most = [token[k : k + 1] for k in range(len(token))], 0
        while len(parts) > 1:
            rank, k = min((self.rank_of.get(a + b, NONE), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NONE:
                return NONE
            most, parts[k : k + 2] = max(most, rank), [parts[k] + parts[k + 1]]
        return most

    @cached_property
    def sure_tokens(self) -> tuple[str, dict[str, int]]:
        """A pattern that cuts a word's bytes, as characters, into tokens whose merges come before all others that could touch them, and single bytes; and the ids of these.

        Merges across a token's borders make tokens that hold the two bytes beside a border. Where all
        such tokens rank above the merges inside, these are made in any case, and unmoved by what is
        outside; so they may as well be made first.
        """
        least, tree, ids = self.crossing(), {}, {bytes([b]).decode("latin-1"): rank for b, rank in enumerate(self.byte_ids)}
        for token, rank in sorted(self.rank_of.items(), key=lambda x: x[1])[: SURE + 256]:
            most = self.greatest_merge(token)
            if len(token) == 1 or most == NONE:
                continue
            before = _byte_class([b for b in range(256) if least[b][token[0]] <= most])
            after = _byte_class([b for b in range(256) if least[token[-1]][b] <= most])
            node = tree
            for b in token:
                node = node.setdefault(b, {})
            node[None] = (f"(?!{after})" if after else "") + (f"(?<!{before}.{{{len(token)}}})" if before else "")
            ids[token.decode("latin-1")] = rank

        def written(node: dict, rest: list[str]) -> str:
            ways = [f"\\x{b:02X}{written(more, [more[None]] if None in more else [])}" for b, more in node.items() if b is not None] + rest
            return f"(?:{'|'.join(ways)})" if len(ways) > 1 else "".join(ways)

        # a first byte's own branch matches it alone too, so that the others are not tried for it
        return "(?s)" + "|".join([f"\\x{b:02X}{written(more, [''])}" for b, more in tree.items()] + ["."]), ids


def _byte_class(members: list[int]) -> str:
    """Bytes as a class of Java's patterns; empty if there are none."""
    ranges: list[list[int]] = []
    for b in members:
        if ranges and ranges[-1][1] == b - 1:
            ranges[-1][1] = b
        else:
            ranges.append([b, b])
    return f"[{''.join(f'\\x{a:02X}-\\x{b:02X}' for a, b in ranges)}]" if ranges else ""


def literal(value: list, kind: str) -> Column:
    """A constant of Spark: the optimizer reads the text once."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False)), kind)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _members(of: str) -> frozenset[int]:
    """Code points of a class of characters, as the library of such vocabularies knows it."""
    single = tiktoken.Encoding("bytes", pat_str=of, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return frozenset(ord(c) for part in _points() for c in bytes(single.encode_ordinary(part)).decode())


def _points():
    """All code points but surrogates, in strings of some thousands: a string object of each at once would take the driver 100 MB."""
    for lo in range(0, 0x110000, 1 << 13):
        if not 0xD800 <= lo < 0xE000:
            yield "".join(map(chr, range(lo, min(lo + (1 << 13), 0xD800) if lo < 0xD800 else lo + (1 << 13))))


@lru_cache(maxsize=4)
def _class(spark: SparkSession, of: str) -> str:
    """A class as Java writes it: its own, and what a newer Unicode adds to that, asked for only within the range where that lies."""
    others = spark.sparkContext._jvm.java.util.regex.Pattern.compile(f"[^{of}]")
    own = {ord(c) for part in _points() for c in others.matcher(part).replaceAll("")}
    more, ranges = sorted(_members(of) - own), []
    for c in more:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    span = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return f"{of}[\\x{{{ranges[0][0]:X}}}-\\x{{{ranges[-1][1]:X}}}&&[{span}]]" if ranges else of


def java_pattern(spark: SparkSession, pattern: str) -> str:
    r"""A pattern of words in Java's syntax with the same classes: \p{L}, \p{N} and \s anywhere, \S outside of brackets."""
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.DOTALL):
        members = _class(spark, part) if part.startswith(r"\p") else WHITE if part == r"\s" else None
        if members is not None:
            out.append(members if inside else f"[{members}]")
        else:
            out.append(f"[^{WHITE}]" if part == r"\S" else part)
        inside = part == "[" or inside and part != "]"
    return "".join(out)


@lru_cache(maxsize=1)
def ranks_in(path: str, changed: int) -> Ranks:
    """A vocabulary is held once; changed: the time of the file's last change."""
    return Ranks(path)


class Merges:
    """Columns that encode and decode by one vocabulary."""

    def __init__(self, path: str):
        self.ranks = ranks_in(path, os.stat(path).st_mtime_ns)

    def bytes_of(self, word: Column) -> Column:
        """Ids of a word's single bytes."""
        ids = literal(self.ranks.byte_ids, "array<bigint>")
        return F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.get(ids, F.ascii(c)))

    def sure_ids(self, word: Column) -> Column:
        """Ids of a word's bytes, of which those that are sure to be joined first already are."""
        pattern, ids = self.ranks.sure_tokens
        cells: list[dict[str, int]] = [{} for _ in range(SURE_CELLS)]
        for piece, rank in ids.items():
            cells[zlib.crc32(piece.encode()) % SURE_CELLS][piece] = rank
        known = literal(cells, "array<map<string,bigint>>")
        pieces = F.regexp_extract_all(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), F.lit(pattern), F.lit(0))
        return F.transform(pieces, lambda piece: F.get(known, (F.crc32(piece) % SURE_CELLS).cast("int"))[piece])

    def segments(self, start: Column) -> Column:
        """A long word cut between bytes that stand together in no token, so that no merge can span the cut."""
        together = literal(self.ranks.joined_bytes(), "array<array<bigint>>")
        cuts = F.filter(F.sequence(F.lit(1), F.size(start) - 1), lambda i: ~F.array_contains(F.get(together, F.get(start, i - 1).cast("int")), F.get(start, i)))
        return let(F.concat(F.array(F.lit(0)), cuts, F.array(F.size(start))), lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda lo, k: F.slice(start, lo + 1, F.get(at, k + 1) - lo)))

    def fold(self, start: Column) -> Column:
        """Merges single bytes, or what they are sure to become, in the order of ranks: of a short word one pair a step, of a long one all pairs of the least rank, from the left."""
        shifts, table = self.ranks.pair_table()
        shifts, table = literal(shifts, "array<bigint>"), literal(table, "array<bigint>")

        def rank(key: Column) -> Column:
            """Of a pair's key; null stays null, and a pair of no rank gets a number from NONE on."""
            place = key % ROW + F.get(shifts, (key % SHIFTS).cast("int"))
            return (F.get(table, place.cast("int")) - F.shiftleft(key, RANK_BITS)).bitwiseAND(F.lit((1 << 62) - 1))

        def ranks_of(s: Column) -> Column:
            return F.transform(F.transform(s, lambda x, i: F.shiftleft(x, RANK_BITS) + F.get(s, i + 1)), rank)

        def first(s: Column, ranks: Column, least: Column) -> Column:
            at = F.array_position(ranks, least).cast("int")
            return F.concat(F.slice(s, F.lit(1), at - 1), F.array(least), F.slice(s, at + 2, F.size(s)))

        def every(s: Column, ranks: Column, least: Column) -> Column:
            marks = F.split(F.replace(F.array_join(F.transform(ranks, lambda r: F.when(r == least, "1").otherwise("0")), ""), F.lit("11"), F.lit("10")), "")
            merged = let(marks, lambda mark: F.transform(s, lambda x, i: F.when(F.get(mark, i) == "1", least).when((i > 0) & (F.get(mark, i - 1) == "1"), F.lit(GONE).cast("long")).otherwise(x)))
            return F.filter(merged, lambda x: x != GONE)

        def merged(s: Column, ranks: Column, least: Column) -> Column:
            some = F.when(F.size(s) < WORD_BYTES, first(s, ranks, least)).otherwise(every(s, ranks, least))
            return F.when(least < NONE, some).otherwise(F.concat(s, F.array(F.lit(DONE).cast("long"))))

        def step(s: Column, _: Column) -> Column:
            # folds over one element name a value as let() does, and copy nothing
            ranked = F.aggregate(F.array(ranks_of(s)), s, lambda s, ranks: F.aggregate(F.array(F.array_min(ranks)), s, lambda s, least: merged(s, ranks, least)))
            return F.when(F.element_at(s, -1) == DONE, s).otherwise(ranked)

        return F.filter(F.aggregate(F.array_repeat(F.lit(0), F.size(start) - 1), start, step), lambda x: x >= 0).cast("array<int>")

    def encoded(self, word: Column) -> Column:
        """Ids of a word that is no token itself and not empty."""
        starts = F.when(F.octet_length(word) < WORD_BYTES, F.array(self.sure_ids(word))).otherwise(let(self.bytes_of(word), self.segments))
        return F.flatten(F.transform(starts, self.fold))

    def words(self, spark: SparkSession) -> DataFrame:
        """(word, ids) of all tokens that are whole characters, and of the empty match."""
        texts = [("", [])] + [(token.decode(), [rank]) for token, rank in self.ranks.rank_of.items() if _is_text(token)]
        return spark.createDataFrame(texts, "word string, ids array<int>")

    def packed(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers, one after the other."""
        digits = literal([i.to_bytes(4, "little").hex() for i in range(len(self.ranks.pieces()))], "array<string>")
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(digits, i)), ""))

    def decoded(self, ids: Column) -> Column:
        """The bytes that ids stand for."""
        pieces = literal(self.ranks.pieces(), "array<string>")
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def _cell(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(WORD_CELLS)).cast("int")


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", *, ids_col: str = "ids", sample_rows: int = SAMPLE_ROWS, share: int = SHARE) -> DataFrame:
    """All columns of docs, and as ids_col (array<int>) the ids of each whole text.

    Every match of `pattern` is encoded apart, by ranks, without special tokens; what no match covers
    has no ids. A null or empty text has none either. Each word of n bytes takes a step for each merge,
    over what is left of it; a long one is cut first where no token could span the cut. Distinct words
    that make up 1 / share of those of about sample_rows rows are folded once and kept in a literal
    map. That only chooses where a word is folded; its ids are the same.
    """
    spark, merges = docs.sparkSession, Merges(vocabulary_path)
    words = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(java_pattern(spark, pattern)), F.lit(0))
    some = docs.select(text_col).sample(min(1.0, sample_rows / max(1, docs.count())), seed=11)
    counts = some.select(F.explode(words).alias("word")).where(f"word <> '' and octet_length(word) <= {WORD_BYTES}").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    own = merges.words(spark)
    often = counts.join(F.broadcast(total)).where((F.col("n") > 1) & (F.col("n") * share >= F.col("total"))).select("word")
    # written first, as a plan that runs on names its literals each time it changes
    often = stored(often.join(F.broadcast(own.select("word")), "word", "left_anti")).select("word", merges.encoded(F.col("word")).alias("ids"))
    cells = [""] * WORD_CELLS
    for word, ids, cell in own.unionByName(often).select("word", "ids", _cell(F.col("word"))).toLocalIterator():
        cells[cell] += f"{',' if cells[cell] else ''}{json.dumps(word, ensure_ascii=False)}:[{','.join(map(str, ids))}]"
    known = F.from_json(F.lit("[{" + "},{".join(cells) + "}]"), "array<map<string,array<int>>>")
    del cells
    give_back()
    ids = F.flatten(F.transform(words, lambda w: F.coalesce(F.get(known, _cell(w))[w], merges.encoded(w))))
    return docs.withColumn(ids_col, ids)


def decode(rows: DataFrame, vocabulary_path: str, ids_col: str = "ids", *, bytes_col: str = "decoded") -> DataFrame:
    """All columns of rows, and as bytes_col the bytes that the ids stand for; null where ids are null or hold what is no id."""
    merges = Merges(vocabulary_path)
    most = len(merges.ranks.pieces())
    good = F.forall(ids_col, lambda i: i.isNotNull() & (i >= 0) & (i < most))
    return rows.withColumn(bytes_col, F.when(good, merges.decoded(F.col(ids_col))))
