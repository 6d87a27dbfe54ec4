"""Mixing sources to target weights, in DataFrame functions alone.

Sizes are words. Each source is one stream of its documents, cut into blocks of `block` words and a
shorter tail. A source's target sets how many slots it has in the mix. Each slot is drawn into one
output shard, so the source counts of the shards are multinomial, given the totals that the targets
fix. Slot k of a source takes the block at index p(k) of a pseudorandom permutation (a new one each
time all blocks have been taken), and slots meet blocks in a join by index. Documents' words are cut
at the blocks' borders, and their pieces joined to the slots are the texts of the mix.

The permutation is swap-or-not: a round reflects an index at a random point if a hash of the higher
one of the two says so. Each round maps [0, n) onto itself, so nothing has to be sorted or stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from philolog.llm._session import checkpoints, stored

#: Words of a block; slots of an output shard; rounds of a permutation.
BLOCK, SHARD_SLOTS, ROUNDS = 256, 4096, 24
#: Rows of a source that one window task orders, about; slots that one row makes.
ROWS_AT_ONCE, SLOTS_AT_ONCE = 500, 4096
#: The mix has this share of all words; weights by a source's place; most times a source is taken.
SHARE, WEIGHTS, MOST = 1.5, (3, 1, 2), 2
SEED = 20


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def permuted(k: Column, n: Column, *key: Column) -> Column:
    """Image of k under a permutation of [0, n) that `key` selects."""

    def one(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) + n - at, n)
        return F.when(F.xxhash64(r, F.lit(SEED + 1), F.greatest(at, other), *key).bitwiseAND(1) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), k, one)


@dataclass
class Mix:
    """sources: a row per source, with `src` (its place), sizes, target and slots. slots: src, index (of
    a block), words (taken, from the block's start), shard. taken: a row per document, with `row` (its
    name here), src, start (its place in the stream), taken (words that the mix takes) and `pieces`, its
    parts that lie in one block or in the tail: at (place within the row), index (null for the tail),
    low (place in the block or tail), n_words, full (times it is taken whole) and part (its first words
    that are taken once more). texts: a row per document with its text, or None if not asked for."""

    sources: DataFrame
    slots: DataFrame
    taken: DataFrame
    texts: DataFrame | None

    def shard_counts(self) -> DataFrame:
        return self.slots.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("slots"))

    def cut(self) -> DataFrame:
        """texts with `pieces` of rows of which something is taken."""
        some = self.taken.where("taken > 0").select("row", "src", "pieces")
        return self.texts.join(some.hint("merge"), "row")

    def blocks(self) -> DataFrame:
        """The mix itself: src, slot, shard, n_words and text of each slot, and of each source's tail as often as it is taken."""
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "row", "cut"))), lambda p: F.rtrim(p["cut"])), "\n")
        parts = of_words("text", lambda words: F.transform("pieces", lambda p: F.struct(p["index"].alias("index"), p["low"].alias("low"), F.slice(words, (p["at"] + 1).cast("int"), p["n_words"].cast("int")).alias("w"))))
        pieces = self.cut().select("row", "src", F.explode(parts).alias("p")).select("row", "src", "p.*")
        tails = self.sources.where("tail > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs")))).withColumn("words", F.when(F.col("epoch") < F.col("epochs"), F.col("tail")).otherwise(F.col("tail_part")))
        tails = tails.where("words > 0").select("src", (-1 - F.col("epoch")).alias("slot"), "words", F.pmod(F.xxhash64(F.lit(SEED + 2), "src", -1 - F.col("epoch")), "shards").alias("shard"))
        cut = F.array_join(F.slice("w", F.lit(1), F.greatest(F.col("words") - F.col("low"), F.lit(0)).cast("int")), "")
        columns = ["src", "slot", "shard", "words", "low", "row", cut.alias("cut")]
        whole = pieces.where("index is not null").join(self.slots.hint("merge"), ["src", "index"]).where("words > low").select(*columns)
        rest = pieces.where("index is null").join(F.broadcast(tails), "src").where("words > low").select(*columns)  # a few rows per source
        return whole.unionByName(rest).groupBy("src", "slot", "shard").agg(F.max("words").alias("n_words"), joined.alias("text"))


#: A word with the space after it.
SPACED = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def of_words(text: str, made: Callable[[Column], Column]) -> Column:
    """What `made` makes of the words of a text, each with the space after it.

    They are bound by a lambda: a column that is used once, within another function's lambda, would be
    moved there by the optimiser, and the text cut anew for each piece.
    """
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(SPACED), F.lit(0))), made)[0]


def _targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, source_size, n_rows. Adds src, weight and target.

    With sources in the order of cap / weight, the level at which those up to a place are full rises
    to its greatest value at the level sought: a source gets level * weight or, if less, its cap.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        sizes.withColumn("src", place)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * MOST)
        .withColumn("level", level)
        .withColumn("target", F.least(F.max("level").over(everything) * F.col("weight"), F.col("cap").cast("double")))
        .drop("cap", "level")
    )


def _slots(sources: DataFrame, block: int) -> DataFrame:
    """Numbers of all slots in chunks, so that a large source's slots are made by many tasks."""
    n = F.col("epochs") * F.col("blocks") + F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_slots - 1) div {SLOTS_AT_ONCE}")))
    chunks = sources.withColumn("n_slots", n).where("n_slots > 0").withColumn("chunk", chunk).repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "chunk")
    first = F.col("chunk") * SLOTS_AT_ONCE
    slots = chunks.withColumn("slot", F.explode(F.sequence(first, F.least(first + SLOTS_AT_ONCE, F.col("n_slots")) - 1)))
    epoch = F.expr("slot div blocks")
    index = permuted(F.expr("slot % blocks"), F.col("blocks"), F.col("src"), F.col("epoch"))
    shard = F.pmod(F.xxhash64(F.lit(SEED + 2), "src", "slot"), F.col("shards"))
    words = F.when((F.col("rest") > 0) & (F.col("slot") == F.col("n_slots") - 1), F.col("rest")).otherwise(F.lit(block))
    return slots.withColumn("epoch", epoch).select("src", "slot", index.alias("index"), words.alias("words"), shard.alias("shard"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block: int = BLOCK, texts: bool = True) -> Mix:
    """Plans the mix of all rows of docs.

    A null text has size 0 and is never taken; a null source is a source of its own, after all
    others. Ids may be null or repeated: each row has its own place in its source's stream, by a hash
    of id and text; of rows with equal hashes the order is by id, size and place in the input. With no
    words at all every target is 0. Reruns over the same rows in the same order give the same mix.
    With `texts` the rows are kept, for blocks() and mix_documents(): `other` holds the columns of
    docs beside the text.
    """
    checkpoints(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [F.col(c) for c in docs.columns if c != text_col]
    kept = [text.alias("text"), (F.struct(*rest) if rest else F.lit(None)).alias("other")] if texts else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("own"), *kept)
    # names by place hold for what was written alone, so rows are stored before anything else is read
    base = stored(base) if texts else base.checkpoint()
    sized = base.select("row", "doc_id", "source", "size", "own")
    targets = _targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")))
    wanted = F.floor(F.col("target")).cast("long")
    sources = (
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0).cast("long")))
        .withColumn("blocks", F.expr(f"source_size div {block}"))
        .withColumn("tail", F.col("source_size") % block)
        .withColumn("left", wanted - F.col("epochs") * F.col("source_size"))
        .withColumn("tail_part", F.least("left", "tail"))
        .withColumn("whole", F.expr(f"(left - tail_part) div {block}"))
        .withColumn("rest", (F.col("left") - F.col("tail_part")) % block)
        .withColumn("shards", F.ceil(F.sum(F.col("target")).over(Window.partitionBy()) / (block * SHARD_SLOTS)).cast("long"))
        .withColumn("shards", F.greatest("shards", F.lit(1).cast("long")))
        .checkpoint()
    )
    # places in the streams: a prefix sum over groups of rows, then one within each group
    known = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rows = known.select("d.row", "d.doc_id", "d.size", "d.own", F.col("s.source").alias("source"), "src", "source_size", "target", "epochs", "blocks", "tail_part", "n_rows")
    rows = rows.withColumn("mark", F.xxhash64("doc_id", "own", F.lit(SEED + 3))).withColumn("part", F.pmod("mark", F.expr(f"n_rows div {ROWS_AT_ONCE} + 1")))
    parts = rows.groupBy("src", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("src", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("src", "part").orderBy("mark", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(parts, ["src", "part"])
    rows = rows.withColumn("start", F.col("offset") + F.col("inner")).drop("part", "mark", "own", "inner", "offset", "n_rows").checkpoint()

    slots = _slots(sources, block)
    takes = slots.groupBy("src", "index").agg(F.sum(F.when(F.col("words") == block, 1).otherwise(0)).alias("times"), F.max(F.when(F.col("words") < block, F.col("words"))).alias("reach"))
    end = F.col("start") + F.col("size")
    edge = F.col("blocks") * block
    # borders within a row, as places of its words: the blocks', and that of the tail
    places = rows.where("size > 0").withColumn("end", F.greatest("start", F.least(end, edge)))
    spans = F.when(F.col("end") > F.col("start"), F.transform(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}")), lambda i: F.struct(i.alias("index"), F.greatest(F.col("start"), i * block).alias("from"), F.least(F.col("end"), (i + 1) * block).alias("to"))))
    tail = F.when(end > edge, F.array(F.struct(F.lit(None).cast("long").alias("index"), F.greatest("start", edge).alias("from"), end.alias("to"))))
    none = F.array().cast("array<struct<index:bigint,from:bigint,to:bigint>>")
    pieces = places.select("row", "src", "start", "blocks", "epochs", "tail_part", F.explode(F.concat(F.coalesce(spans, none), F.coalesce(tail, none))).alias("p"))
    pieces = pieces.select("*", F.col("p.index").alias("index")).join(takes.hint("merge"), ["src", "index"], "left")
    is_tail = F.col("index").isNull()
    low = F.col("p.from") - F.when(is_tail, edge).otherwise(F.col("index") * block)
    n = F.col("p.to") - F.col("p.from")
    full = F.when(is_tail, F.col("epochs")).otherwise(F.coalesce("times", F.lit(0)))
    reach = F.when(is_tail, F.col("tail_part")).otherwise(F.coalesce("reach", F.lit(0)))
    part = F.greatest(F.lit(0).cast("long"), F.least(n, reach - low))
    piece = F.struct((F.col("p.from") - F.col("start")).alias("at"), "index", low.alias("low"), n.alias("n_words"), full.alias("full"), part.alias("part"))
    # a row has a piece for every `block` words, so what is gathered is smaller than its text
    sums = pieces.groupBy("row").agg(F.sum(full * n + part).alias("taken"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    taken = rows.join(sums.hint("merge"), "row", "left").select("row", "src", "start", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "pieces")
    return Mix(sources, slots, taken, base.select("row", "text", "other") if texts else None)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of docs with the words that the mix takes of each: first what is taken at all, then what is taken again.

    A row's words come in their order, those that are taken twice once more after them, so each source
    meets its target to a word. Rows are told apart by their place in the input, not by their ids; one
    of which nothing is taken goes. Columns are those of docs.
    """
    mix = mix_sources(docs, id_col, text_col, source_col)
    times = lambda p: p["full"] + F.when(p["part"] > 0, 1).otherwise(0)
    most = F.array_max(F.transform("pieces", times))

    def cuts(words: Column, t: Column) -> Column:
        taken = F.filter("pieces", lambda p: times(p) >= t)
        return F.transform(taken, lambda p: F.array_join(F.slice(words, (p["at"] + 1).cast("int"), F.when(t <= p["full"], p["n_words"]).otherwise(p["part"]).cast("int")), ""))

    # pieces that follow each other join as they were; else a line ends between them
    all_cuts = of_words("text", lambda words: F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), most), lambda t: cuts(words, t))))
    spaced = F.transform(all_cuts, lambda c: F.when(c.rlike(r"[\x20\x09-\x0D]$"), c).otherwise(F.concat(c, F.lit("\n"))))
    text = F.regexp_replace(F.array_join(spaced, ""), r"\n$", "")
    joined = mix.cut().withColumn("mixed", text)
    return joined.select(*[F.col("mixed").alias(c) if c == text_col else F.col("other")[c].alias(c) for c in docs.columns])
