"""The trie of all conversations' prefixes, by radix partitioning from the first turn on.

Turns become codes of a dictionary. Equal conversations are one sequence with a weight. All sequences
are a bucket; a bucket too large for a task skips the turns that all of it share, which are a chain of
nodes, and is dealt by its next code into smaller ones, round by round. A bucket that fits is finished
by multikey quicksort in a task, whose recursion emits its nodes. Nodes above such buckets get their
totals from below, round by round.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from philolog.llm._session import stored

#: Turns of a bucket that one task finishes; ids of a piece of a digest's text; depths of a block of a running sum.
LOCAL_TURNS, PIECE_IDS, BLOCK = 1 << 15, 8192, 1024
WORD = r"[^\x20\x09-\x0D]+"


def _parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def coded_turns(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, code, words): each conversation's turns, numbered from 1 on by order (null first, ties by role and text).

    A null role or text counts as empty; rows without a conversation take no part. Equal pairs of role
    and text have equal codes. The numbers come from a sort of all rows by ranges, so that a
    conversation with a large share of all turns is cut over many tasks.
    """
    full = turns.select(F.col(conversation).cast("long").alias("conv_id"), F.col(order).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    full = full.withColumn("head", F.substring("text", 1, 32)).repartitionByRange(_parts(turns), "conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = stored(full.select("conv_id", key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    codes = stored(rows.groupBy("key").agg(F.max("words").alias("words")).withColumn("code", F.monotonically_increasing_id()))
    placed = rows.drop("words").join(runs.select("conv_id", "part", "first", "before"), ["conv_id", "part"])
    return stored(placed.join(codes, "key").select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "code", "words"))


def digests(members: DataFrame) -> DataFrame:
    """(rep, digest) of members (rep, conv_id, weight: members of rep): SHA-256 of its conv_ids in ascending order, joined by commas.

    Ids are joined in pieces by tasks that hold ranges of the sorted rows. What is not one piece is
    digested piece after piece, in constant memory; a digest of one text can't be divided further.
    """

    def pieces(batches):
        rep, first, total, ids = None, 0, 0, []

        def piece():
            return rep, first, len(ids), total, ",".join(map(str, ids))

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["rep", "first", "n", "total", "ids"])

        for batch in batches:
            out, reps, convs, weights = [], *(batch.column(k).to_numpy() for k in range(3))
            borders = np.concatenate(([0], np.flatnonzero(np.diff(reps)) + 1, [len(reps)])) if len(reps) else np.zeros(1, int)
            for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                if ids and int(reps[lo]) != rep:
                    out.append(piece())
                    ids = []
                while lo < hi:
                    if not ids:
                        rep, first, total = int(reps[lo]), int(convs[lo]), int(weights[lo])
                    some = convs[lo : min(hi, lo + PIECE_IDS - len(ids))].tolist()
                    ids += some
                    lo += len(some)
                    if len(ids) == PIECE_IDS:
                        out.append(piece())
                        ids = []
            if out:
                yield table(out)
        if ids:
            yield table([piece()])

    def whole(batches):
        rep, sha = None, None
        for batch in batches:
            out = []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != rep:
                    if sha:
                        out.append((rep, sha.hexdigest()))
                    rep, sha = r, hashlib.sha256(text.encode())
                else:
                    sha.update(f",{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["rep", "digest"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([sha.hexdigest()])], ["rep", "digest"])

    n = _parts(members)
    cut = stored(members.select("rep", "conv_id", "weight").repartitionByRange(n, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(pieces, "rep long, first long, n long, total long, ids string"))
    more = cut.where("n < total").select("rep", "ids", "first").repartition(n, "rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(whole, "rep long, digest string")
    return cut.where("n = total").select("rep", F.sha2("ids", 256).alias("digest")).unionByName(more)


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, top boolean"


def quicksorted(reps: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, words: np.ndarray) -> list[list]:
    """Nodes of one bucket of distinct sequences codes[starts[i]:ends[i]] that share their first code.

    As [conv, steps below the top, parent's place in the list, n_convs, children, leaves, saved, end_rep].
    Three-way partitions on one code at a time; the equal part is a node.
    """
    nodes: list[list] = []
    stack = [(np.arange(len(reps)), 0, -1)]
    while stack:
        rows, k, parent = stack.pop()
        if len(rows) == 1:
            i = int(rows[0])
            rep, n, lo, hi = int(reps[i]), int(weights[i]), int(starts[i]) + k, int(ends[i])
            if lo == hi:
                nodes[parent][7] = rep
            for at in range(lo, hi):
                nodes.append([rep, k, parent, n, 0, 0, (n - 1) * int(words[at]), rep if at == hi - 1 else None])
                parent, k = len(nodes) - 1, k + 1
            continue
        at = starts[rows] + k
        over = at >= ends[rows]
        if over.any():
            nodes[parent][7] = int(reps[rows[over][0]])
            rows, at = rows[~over], at[~over]
            if not len(rows):
                continue
        here = codes[at]
        pivot = here[len(here) // 2]
        less, more = here < pivot, here > pivot
        for side in (less, more):
            if side.any():
                stack.append((rows[side], k, parent))
        same = ~(less | more)
        rows = rows[same]
        n = int(weights[rows].sum())
        nodes.append([int(reps[rows].min()), k, parent, n, 0, 0, (n - 1) * int(words[at[same][0]]), None])
        stack.append((rows, k + 1, len(nodes) - 1))
    for node in reversed(nodes):
        node[5] = node[5] or 1
        if node[2] >= 0:
            above = nodes[node[2]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return nodes


def _finished(table: pa.Table) -> pa.Table:
    """Nodes of all buckets of a shard."""
    table = table.sort_by([("bucket", "ascending"), ("rep", "ascending"), ("depth", "ascending")])
    bucket, top, parent, rep, depth, code, words, weight = (table[c].to_numpy() for c in ("bucket", "top", "parent", "rep", "depth", "code", "words", "weight"))
    of_rep = np.flatnonzero(np.concatenate(([True], (rep[1:] != rep[:-1]) | (bucket[1:] != bucket[:-1]))))
    ends = np.append(of_rep[1:], len(rep))
    of_bucket = np.flatnonzero(np.concatenate(([True], bucket[of_rep][1:] != bucket[of_rep][:-1])))
    out = []
    for lo, hi in zip(of_bucket.tolist(), np.append(of_bucket[1:], len(of_rep)).tolist(), strict=True):
        at, first = of_rep[lo:hi], int(of_rep[lo])
        nodes = quicksorted(rep[at], weight[at], at, ends[lo:hi], code, words)
        own, above = int(top[first]), int(parent[first])
        out += [(conv, own + k, above if up < 0 else nodes[up][0], n, c, leaves, saved, end, up < 0) for conv, k, up, n, c, leaves, saved, end in nodes]
    kinds = [pa.int64()] * 8 + [pa.bool_()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in NODE.split(", ")])


def _from_here(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows of the same keys from this one on, by blocks of the order."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / BLOCK)).withColumn("_value", value)
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_later"))
    blocks = blocks.withColumn("_later", F.coalesce(F.sum("_later").over(Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("_value").over(Window.partitionBy(*keys, "_block").orderBy(F.desc(order)))
    return rows.join(blocks, [*keys, "_block"]).withColumn(name, F.col("_later") + within).drop("_block", "_value", "_later")


def prefix_trie(turns: DataFrame, conversations: DataFrame, *, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """A row for each distinct sequence of first turns, the empty one included.

    turns: (conv_id, place, code, words) with places 1, 2, ... of each conversation, no nulls;
    conversations: (conv_id), each once, those without turns too. Columns: conv_id (the node's smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (over the subtree, n_convs - 1 times the words of the last turn), ends_sha256 (digest
    of the members that end here). Without conversations there is no node. Sequences are told apart by
    128 bits of hashes of their places and codes.
    """
    marks = [F.bit_xor(F.xxhash64("place", "code")).alias("a"), F.bit_xor(F.xxhash64("code", F.lit(7), "place")).alias("b")]
    known = conversations.join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), *marks), "conv_id", "left").na.fill(0, ["n_turns", "a", "b"])
    known = stored(known)
    classes = stored(known.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    ends = digests(known.join(classes, ["n_turns", "a", "b"]).select("rep", "conv_id", "weight"))
    rows = turns.join(classes.select(F.col("rep").alias("conv_id"), "n_turns", "weight"), "conv_id")
    active = stored(rows.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("top"), F.lit(None).cast("long").alias("parent"), F.col("conv_id").alias("rep"), F.col("place").alias("depth"), "code", "words", "n_turns", "weight"))
    empty = F.min(F.when(F.col("n_turns") == 0, F.col("rep")))
    root = classes.agg(F.min("rep").alias("bucket"), F.count(F.lit(1)).alias("reps"), F.sum("weight").alias("n"), empty.alias("none")).where("bucket is not null")
    heads = stored(root.select("bucket", F.lit(0).cast("long").alias("top"), F.lit(None).cast("long").alias("parent"), "reps", "n", "none"))
    first = heads.first()
    if first is not None:
        active = active.withColumn("bucket", F.lit(first["bucket"]))
    rounds, local = [], []
    while first is not None:
        levels = active.groupBy("bucket", "top", "depth").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.count(F.lit(1)).alias("here"), F.min("words").alias("words"), F.min(F.when(F.col("n_turns") == F.col("depth"), F.col("rep"))).alias("end_rep"))
        levels = stored(levels)
        bad = F.min(F.when((F.col("lo") != F.col("hi")) | (F.col("here") < F.col("reps")), F.col("depth")))
        spans = heads.join(levels, ["bucket", "top"], "left").groupBy("bucket", "top").agg(F.coalesce(bad - 1, F.max("depth"), F.first("top")).alias("last"))
        spans = stored(heads.join(spans, ["bucket", "top"]))
        here = active.join(spans.select("bucket", "top", "last"), ["bucket", "top"])
        children = here.where("depth = last + 1").groupBy("bucket", "top", "last", "code").agg(F.min("rep").alias("child"), F.count(F.lit(1)).alias("reps"), F.sum("weight").alias("n"), F.sum(F.col("n_turns") - F.col("depth") + 1).alias("size"))
        children = stored(children)
        rounds.append((levels, spans, children.groupBy("bucket", "last").agg(F.count(F.lit(1)).alias("n_children"))))
        dealt = here.where("depth = last + 1").join(children.select("bucket", "top", "code", "child", "size"), ["bucket", "top", "code"]).select("rep", "child", "size")
        below = here.where("depth > last").join(dealt, "rep")
        below = stored(below.select(F.col("child").alias("bucket"), (F.col("last") + 1).alias("top"), F.col("bucket").alias("parent"), "rep", "depth", "code", "words", "n_turns", "weight", (F.col("size") <= local_turns).alias("local")))
        local.append(below.where("local").drop("local"))
        active = below.where("not local").drop("local")
        heads = stored(children.where(F.col("size") > local_turns).select(F.col("child").alias("bucket"), (F.col("last") + 1).alias("top"), F.col("bucket").alias("parent"), "reps", "n", F.lit(None).cast("long").alias("none")))
        first = heads.first()
    if not local:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    small = local[0]
    for more in local[1:]:
        small = small.unionByName(more)
    shards = max(1, math.ceil(2 * small.count() / local_turns))
    small = small.withColumn("shard", F.pmod(F.xxhash64("bucket", "top"), F.lit(shards)).cast("int"))
    done = stored(small.groupBy("shard").applyInArrow(_finished, NODE))
    nodes, tops = done, done.where("top").select("parent_conv_id", "depth", "n_leaves", "saved_tokens")
    for levels, spans, counts in reversed(rounds):
        totals = tops.groupBy(F.col("parent_conv_id").alias("bucket"), (F.col("depth") - 1).alias("last")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        ended = spans.join(totals, ["bucket", "last"], "left").join(counts, ["bucket", "last"], "left")
        chain = levels.join(spans.select("bucket", "top", "last"), ["bucket", "top"]).where("depth <= last").select("bucket", "top", "depth", "words", "end_rep")
        chain = chain.unionByName(spans.where("top = 0").select("bucket", "top", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.col("none").alias("end_rep")))
        chain = _from_here(chain, ["bucket", "top"], "depth", F.col("words"), "text").join(ended, ["bucket", "top"])
        at_end = F.col("depth") == F.col("last")
        made = stored(
            chain.select(
                F.col("bucket").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("bucket")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(at_end, F.coalesce("n_children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
                (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("text")).cast("long").alias("saved_tokens"), "end_rep", (F.col("depth") == F.col("top")).alias("top"),
            )
        )
        nodes = nodes.unionByName(made)
        tops = tops.unionByName(made.where("top").select("parent_conv_id", "depth", "n_leaves", "saved_tokens"))
    out = nodes.join(ends.withColumnRenamed("rep", "end_rep"), "end_rep", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
