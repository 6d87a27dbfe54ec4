"""N-gram Jaccard join: texts whose sets of word shingles are alike, and the groups they form.

Method: count-vector R-tree. Shingle hashes are dealt into groups, and a set becomes the point of
its group counts. Two sets share at most the sum of the coordinate minima of their points.

1. Blocking. In any one order of all shingles, two sets of n and m shingles that link share one of
   the first n - needed + 1 and m - needed + 1 of theirs, as the least common shingle has at most that
   many before it. The order puts shingles that a sample of rows shows to be common last, so frequent
   passages that unlike texts share rarely make a key; whatever the sample, no link is lost. The sets
   of a key are taken as pairs if they are few, and the pairs that the bound on the points rules out
   are dropped. Of the sets of a key that more share, an R-tree over their points gives the pairs that
   the bound leaves, and a forest of them is kept. The sets of a key that very many share become a
   star, first within an Arrow batch and then across them, so such a key holds one row for each batch
   however many texts share it.
2. The components of these edges are the units within which all links lie. A small unit is one tile.
   A unit of more sets or bytes is cut into cells by size, such that links reach the next cell at
   most, and cells into tiles of bounded size. A few pivots of each cell are compared with all sets
   of the cell and its neighbours, which settles the bulk of a large group of near copies.
3. In a tile an R-tree over the points yields the pairs that the bound cannot rule out and that are
   not yet connected; each is verified on its whole sets, and a forest of the links is returned.
   Sets outside their unit's largest group are then compared with the tiles of their own and the
   neighbouring cells; two sets of that group need no comparison, as they are connected already.
4. Components of the forests are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from philolog.llm import _bytes
from philolog.llm._session import checkpoints, stored
from philolog.llm.bloom import Bloom
from philolog.llm.components import connected_components

#: Rows of the sample that common shingles are looked for in, about, and how many of them every task knows.
SAMPLE_ROWS, COMMON = 10_000, 400_000
#: Sets of a key that are taken as pairs, and that an R-tree takes; more become a star.
FEW, MANY = 8, 2048
#: Shingles for each counter of a point, about, and the fewest and most counters.
PER_COUNTER, COUNTERS = 8, (16, 4096)
#: Sets of a tile, and bytes of their shingle hashes; a larger set is a tile of its own, about.
TILE_SETS, TILE_BYTES = 4096, 16 << 20
#: Rows of an Arrow batch whose keys are held at once.
ROWS_AT_ONCE = 2000
#: Sets of a cell that are compared with all sets of it and of its neighbours.
PIVOTS = 4
_STEP = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) * (2 * k + 3) % 2**64 | 1) for k in range(64)]


class Threshold:
    """Exact arithmetic for `percent` * union <= 100 * intersection."""

    def __init__(self, percent: int):
        self.percent = percent

    def needed(self, total):
        """Least intersection of two sets that link and have `total` elements together."""
        return -(-self.percent * total // (100 + self.percent))

    def partner(self, size):
        """Most elements that a set linked to one of `size` can have."""
        return 100 * size // self.percent

    def unlike(self, size: int) -> bool:
        """Whether a set of this size can link with one that isn't equal to it."""
        return 100 * size >= self.percent * (size + 1) or 100 * (size - 1) >= self.percent * size

    def prefix(self, size: int) -> int:
        """How many of its first shingles a set must show, whatever the size of its partner."""
        return size - -(-self.percent * size // 100) + 1


def shingle_sets(w: _bytes.Words, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a shorter text is one shingle."""
    h, out = w.hashes, []
    n = len(h) - width + 1
    if n > 0:
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += h[k : k + n] * _STEP[k]
        rolled = _bytes.mix(rolled)
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif b > a:
            # a length mark keeps short sequences apart from full shingles
            short = int(np.add.reduce(h[a:b] * np.array(_STEP[: b - a], np.uint64))) + (b - a) * 0x51ED270B27B4F3CF
            out.append(_bytes.mix(np.array([short % 2**64], np.uint64)))
        else:
            out.append(h[:0])
    return out


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = int(np.add.reduce(_bytes.mix(s ^ np.uint64(0xA0761D6478BD642F)))) + len(s) * 0xE7037ED1A0B428DB
    return int(_bytes.mix(np.array([total % 2**64], np.uint64)).view(np.int64)[0])


def prefix_keys(s: np.ndarray, t: Threshold, common: np.ndarray) -> np.ndarray:
    """The shingles of a set that come first in the order: seldom ones, then those of `common` (sorted, with ranks in their low bits)."""
    if not t.unlike(len(s)):
        return s[:0]
    n = t.prefix(len(s))
    rank = np.zeros(len(s), np.uint64)
    if len(common):
        names = common & _NAME
        at = np.minimum(np.searchsorted(names, s & _NAME), len(names) - 1)
        rank = np.where(names[at] == s & _NAME, (common[at] & _RANK) + np.uint64(1), np.uint64(0))
    # of one rank the order is that of the hashes
    order = np.lexsort((s, rank))[:n]
    return s[order]


#: A common shingle in one number: its name above, how common it is below.
_RANK = np.uint64((1 << 6) - 1)
_NAME = ~_RANK


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that several rows of a sample hold, as prefix_keys() takes them. They set an order only, so any sample will do."""
    n = docs.count()
    sample = docs.select("text").sample(fraction=min(1.0, SAMPLE_ROWS / max(n, 1)), seed=4)

    def count(batches):
        for batch in batches:
            sets = list(_sets_of(batch.column(0), width))
            if sets:
                names, times = np.unique(np.concatenate(sets) & _NAME, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(times)], ["name", "n"])

    seen = sample.mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    seen = seen.orderBy(F.desc("n"), "name").limit(COMMON).toPandas()
    rank = np.minimum(np.log2(seen["n"].to_numpy(np.float64)) * 3, float(_RANK) - 1).astype(np.uint64) if len(seen) else np.zeros(0, np.uint64)
    return np.sort(seen["name"].to_numpy(np.int64).view(np.uint64) | rank)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One (key, least node) for each key, and the edges from that node to the key's other nodes."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    head = nodes[first][np.cumsum(first) - 1] if len(keys) else nodes
    other = head != nodes
    pairs = np.unique(np.stack((head[other], nodes[other]), 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return keys[first], nodes[first], *_thin(pairs)


def _thin(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of some edges."""
    names, ends = np.unique(pairs, return_inverse=True)
    ends, forest = ends.reshape(-1, 2), Forest(len(names))
    kept = [i for i, (a, b) in enumerate(ends.tolist()) if forest.join(a, b)]
    return pairs[kept, 0], pairs[kept, 1]


def _sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, w in _bytes.word_blocks(column):
        yield from shingle_sets(w, width)


def point_of(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles in groups; a larger set has more groups, always a power of two."""
    least, most = COUNTERS
    groups = min(max(1 << max(len(s) // PER_COUNTER, 1).bit_length() - 1, least), most)
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint32)


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """Most shingles that two sets with these points share: the sum of the coordinate minima, after the longer point is folded."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(0)).sum())


def describe(docs: DataFrame, width: int) -> DataFrame:
    """docs (id, text, mark) as (id, mark, n, node, point): size, name and point of each text's shingle set; node is null for an empty one."""

    def run(batches):
        for batch in batches:
            n, names, points = [], [], []
            for s in _sets_of(batch.column(1), width):
                n.append(len(s))
                names.append(fingerprint(s) if len(s) else None)
                points.append(point_of(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(points, pa.binary())], ["id", "mark", "n", "node", "point"])

    return docs.mapInArrow(run, "id long, mark long, n long, node long, point binary")


def _shared_keys(docs: DataFrame, width: int, t: Threshold, buckets: int) -> DataFrame:
    """(u, v, kind) of set names that share a blocking key: pairs of a key with few sets, rows (key, set) of one with more, and a star of one with very many."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))
    flag = np.uint64(1)  # the lowest bit of a key's row says that it stands for a star

    def emit(batches):
        for batch in (b.slice(lo, ROWS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, ROWS_AT_ONCE)):
            keys, nodes, sizes = [], [], []
            seen = set()
            for s in _sets_of(batch.column(0), width):
                if len(s) and (name := fingerprint(s)) not in seen:
                    seen.add(name)
                    k = prefix_keys(s, t, common.value)
                    if len(k):
                        keys.append(k)
                        nodes.append(name)
                        sizes.append(len(k))
            if not keys:
                continue
            keys, nodes = np.concatenate(keys) & ~flag, np.repeat(np.array(nodes, np.int64), sizes)
            keys, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
            hot = times[inverse] > MANY
            heads, at, us, vs = _stars(keys[inverse[hot]], nodes[hot])
            keys, nodes = np.concatenate((keys[inverse[~hot]], heads | flag)), np.concatenate((nodes[~hot], at))
            order = np.argsort(keys)
            keys, nodes = keys[order], nodes[order]
            bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts = np.concatenate(([0], cuts)).astype(int)
            packed = [np.concatenate((a, b.view(np.uint64))).tobytes() for a, b in zip(np.split(keys, cuts), np.split(nodes, cuts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "packed"])
            if len(us):
                edges = np.concatenate((us, vs)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(us[0]) % buckets], pa.int32()), pa.array([edges], pa.binary())], ["bucket", "packed"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in table["packed"].to_pylist()]
        both = np.concatenate(parts, 1) if parts else np.zeros((2, 0), np.uint64)
        few = some = np.zeros((0, 2), np.int64)
        if table["bucket"][0].as_py() < 0:
            us, vs = _thin(both.view(np.int64).T)
        else:
            nodes = both[1].view(np.int64)
            names, inverse, times = np.unique(both[0] & ~flag, return_inverse=True, return_counts=True)
            large = (times > MANY) | (np.bincount(inverse, both[0] & flag, len(times)) > 0)
            few = _pairs(inverse[((times > 1) & (times <= FEW) & ~large)[inverse]], nodes[((times > 1) & (times <= FEW) & ~large)[inverse]])
            middle = ((times > FEW) & ~large)[inverse]
            some = np.stack((names.view(np.int64)[inverse[middle]], nodes[middle]), 1)
            _, _, us, vs = _stars(inverse[large[inverse]].astype(np.uint64), nodes[large[inverse]])
        kind = np.repeat(np.array([PAIR, SHARED, STAR], np.int8), [len(few), len(some), len(us)])
        return pa.table({"u": pa.array(np.concatenate((few[:, 0], some[:, 0], us)), pa.int64()), "v": pa.array(np.concatenate((few[:, 1], some[:, 1], vs)), pa.int64()), "kind": pa.array(kind)})

    packed = docs.select("text").mapInArrow(emit, "bucket int, packed binary")
    return packed.groupBy("bucket").applyInArrow(meet, "u long, v long, kind tinyint")


#: Kinds of rows of _shared_keys().
PAIR, SHARED, STAR = 0, 1, 2


def bound_forest(points: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """A forest that joins all sets which the bound on their points leaves as possible links."""
    sizes, lengths = np.array([int(p.sum()) for p in points], np.int64), np.array([len(p) for p in points])
    group, found = np.arange(len(points)), []
    # sets that link differ by less than a factor of two in size, so by one step of length at most
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero((lengths == length) | (lengths == 2 * length))
        if len(own) < 2:
            continue
        tree = RTree(np.stack([points[i].reshape(-1, length).sum(0) for i in own.tolist()]).astype(np.int32), sizes[own], t)
        for k, i in enumerate(own.tolist()):
            near = own[tree.query(k)]
            near = near[(group[near] != group[i]) & ((lengths[near] == length) | (lengths[i] == length))]
            for j in near.tolist():
                if group[i] != group[j]:
                    group[group == group[j]] = group[i]
                    found.append((i, j))
    return found


def _pairs(groups: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Distinct pairs (lesser name, greater name) of nodes of one group; groups have at most FEW rows."""
    order = np.lexsort((nodes, groups))
    groups, nodes = groups[order], nodes[order]
    out = [np.zeros((0, 2), np.int64)]
    for step in range(1, FEW):
        if len(groups) <= step:
            break
        same = (groups[step:] == groups[:-step]) & (nodes[step:] != nodes[:-step])
        out.append(np.stack((nodes[:-step][same], nodes[step:][same]), 1))
    return np.unique(np.concatenate(out), axis=0)


def _units(docs: DataFrame, known: DataFrame, width: int, t: Threshold, buckets: int) -> DataFrame:
    """Edges (u, v) between set names such that every link lies within a component."""
    shared = _shared_keys(docs, width, t, buckets).distinct().checkpoint()
    points = known.where("node is not null").groupBy("node").agg(F.first("point").alias("point"))
    asked = shared.where(F.col("kind") == PAIR)
    for end in ("u", "v"):
        asked = asked.join(points.select(F.col("node").alias(end), F.col("point").alias(f"{end}_point")), end)
    held = shared.where(F.col("kind") == SHARED).select(F.col("u").alias("key"), F.col("v").alias("node")).join(points, "node")

    def forest(table: pa.Table) -> pa.Table:
        names = table["node"].to_numpy()
        edges = bound_forest([np.frombuffer(x, np.uint32) for x in table["point"].to_pylist()], t)
        return pa.table({"u": pa.array(names[[a for a, _ in edges]], pa.int64()), "v": pa.array(names[[b for _, b in edges]], pa.int64())})

    def bounded(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("u_point", "v_point"))
            may = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                may.append(reach(x, y) >= t.needed(int(x.sum()) + int(y.sum())))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(may, pa.bool_()))

    stars = shared.where(F.col("kind") == STAR).select("u", "v")
    return stars.unionByName(asked.mapInArrow(bounded, "u long, v long")).unionByName(held.groupBy("key").applyInArrow(forest, "u long, v long"))


class RTree:
    """Bulk-loaded R-tree over count vectors; a query yields points that may share enough with it."""

    LEAF = 32
    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, t: Threshold):
        self.t, self.points, self.sizes = t, points, sizes
        # neighbours in this order have like sizes and, within those, like main coordinates
        main = np.argsort(-points.var(0))[:2]
        self.order = np.lexsort((points[:, main[-1]], points[:, main[0]], class_rank(sizes)))
        self.levels, at = [], self.order
        most, least, top = points[at], sizes[at], sizes[at]
        fan = self.LEAF
        while len(most) > 1:
            cuts = np.arange(0, len(most), fan)
            most, least, top = np.maximum.reduceat(most, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(top, cuts)
            self.levels.append((fan, most, least, top))
            fan = self.FAN

    def may(self, q: np.ndarray, size: int, most: np.ndarray, least: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Which boxes (upper corner, least and greatest size) can hold a set that links with the query."""
        reach = np.minimum(most, q).sum(1)
        return (reach >= self.t.needed(size + least)) & (top * 100 >= self.t.percent * size) & (least <= self.t.partner(size))

    def query(self, i: int) -> np.ndarray:
        """Points other than i that the bound does not rule out."""
        q, size = self.points[i], int(self.sizes[i])
        at = None
        for fan, most, least, top in reversed(self.levels):
            at = np.arange(len(most)) if at is None else at[at < len(most)]
            at = at[self.may(q, size, most[at], least[at], top[at])]
            at = (at[:, None] * fan + np.arange(fan)).ravel()
        at = self.order[at[at < len(self.order)] if at is not None else np.zeros(0, int)]
        at = at[self.may(q, size, self.points[at], self.sizes[at], self.sizes[at])]
        return at[at != i]


def class_rank(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / math.log(1.05)).astype(int)


def n_shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def links_forest(sets: list[np.ndarray], t: Threshold, group: np.ndarray | None = None, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the sets' groups (at first each its own, or as given) as far as all links do.

    With `asks`, only links between a set that asks and one that doesn't are sought.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    counters = 1 << max(4, min(9, int(np.median(sizes)).bit_length() - 2))
    points = np.zeros((len(sets), counters), np.int32)
    for i, s in enumerate(sets):
        points[i] = np.bincount((s & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
    tree, found = RTree(points, sizes, t), []
    group = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1]
    for i in range(len(sets)) if asks is None else np.flatnonzero(asks).tolist():
        near = tree.query(i)
        near = near[(group[near] != group[i]) & (True if asks is None else ~asks[near])]
        for j in near.tolist():
            if group[i] != group[j] and n_shared(sets[i], sets[j]) >= t.needed(sizes[i] + sizes[j]):
                group[group == group[j]] = group[i]
                found.append((i, j))
    return found


def _packed_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a binary column, as views of its memory."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32, len(chunk) + 1, chunk.offset * 4).tolist()
        out += [np.frombuffer(data, np.uint64, (b - a) // 8, a) for a, b in zip(at, at[1:], strict=False)]
    return out


def _compared(table: pa.Table, t: Threshold) -> pa.Table:
    """(u, v) of the links that a tile's sets need; rows (node, set, label, asks), of which a node may come twice on a side."""
    names, label, asks = (table[c].to_numpy() for c in ("node", "label", "asks"))
    _, first = np.unique(np.stack((names, asks.astype(np.int64)), 1), axis=0, return_index=True)
    held = _packed_sets(table["set"])
    sets = [held[i] for i in first.tolist()]
    names, asks = names[first], asks[first]
    # phase one has no asking sets: all are compared with all
    links = links_forest(sets, t, label[first], asks if asks.any() else None) if len(sets) > 1 else []
    return pa.table({"u": pa.array(names[[a for a, _ in links]], pa.int64()), "v": pa.array(names[[b for _, b in links]], pa.int64())})


def _with_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """members with `set`, the packed shingle hashes of the one text that a member's row names.

    A Bloom filter of the rows that are named keeps the others from being cut and shuffled.
    """
    key = lambda of: F.xxhash64(of, "mark").alias("key")
    named = docs.sparkSession.sparkContext.broadcast(Bloom.of(members.select(key("least"))))

    def cut(batches):
        # of rows with one id and one text, each task sends one
        sent: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            may = named.value.may(keys.view(np.uint64))
            for k in np.flatnonzero(may).tolist():
                may[k] = keys[k] not in sent
                sent.add(int(keys[k]))
            batch = batch.filter(pa.array(may))
            sets = [(fingerprint(s), s.tobytes()) for s in _sets_of(batch.column("text"), width)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in sets], pa.int64()), batch.column("key"), pa.array([x for _, x in sets], pa.binary())], ["node", "key", "set"])

    sets = docs.where("text is not null").select("text", key("id")).mapInArrow(cut, "node long, key long, set binary")
    # one row of each task comes along; a tile takes each set once
    return members.withColumn("key", key("least")).drop("least", "mark").join(sets, ["node", "key"]).drop("key")


def _cells(members: DataFrame, t: Threshold) -> DataFrame:
    """members (unit, node, n) with cell (by size; 0 in a small unit), large (whether the unit has several tiles), tiles (of the cell), tile, and those of the cells beside it."""
    ratio = math.log(100 / t.percent * 1.001)
    whole = members.groupBy("unit").agg((F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum("n") * 8 / TILE_BYTES) > 1).alias("large"))
    members = members.join(whole, "unit").withColumn("cell", F.when(F.col("large"), F.floor(F.ln("n") / ratio).cast("int")).otherwise(0))
    node = F.col("node")
    pivots = F.array_distinct(F.array(*[F.min(node.bitwiseXOR(F.lit(_pivot_mask(k)))).bitwiseXOR(F.lit(_pivot_mask(k))) for k in range(PIVOTS)]))
    cells = members.groupBy("unit", "cell").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum("n") * 8 / TILE_BYTES)).cast("int").alias("tiles"), pivots.alias("pivots"))
    cells = _beside(cells, "tiles")
    return members.join(cells, ["unit", "cell"]).withColumn("tile", F.pmod(F.xxhash64(node), F.col("tiles")).cast("int"))


def _pivot_mask(k: int) -> int:
    return int(_bytes.mix(np.array([k], np.uint64)).view(np.int64)[0])


def _beside(cells: DataFrame, column: str) -> DataFrame:
    """Adds the column's value in the cells before and after, 0 where there is none; a unit has as many cells as there are size classes."""
    by_cell = Window.partitionBy("unit").orderBy("cell")

    def at(step: int):
        f = F.lag if step < 0 else F.lead
        return F.when(f("cell").over(by_cell) == F.col("cell") + step, f(column).over(by_cell)).otherwise(0)

    return cells.withColumns({f"{column}_before": at(-1), f"{column}_after": at(1)})


def _places(cell, count, *more) -> Column:
    """array<struct<cell, tile, ...>> of the tiles 0 .. count - 1 of a cell."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda j: F.struct(cell.alias("cell"), j.alias("tile"), *more))).otherwise(F.array())


def _around(cells: str) -> Column:
    """The tiles of a row's own cell and of those beside it, as the columns `cells`, `cells`_before and `cells`_after count them."""
    cell = F.col("cell")
    return F.concat(_places(cell, F.col(cells)), _places(cell - 1, F.col(f"{cells}_before")), _places(cell + 1, F.col(f"{cells}_after")))


def _second(sets: DataFrame, first: DataFrame, t: Threshold) -> DataFrame:
    """Links of sets outside their unit's largest group of the first comparison, with all sets of cells that they may reach."""
    label = F.coalesce("root", "node")
    known = sets.where("large").join(first, "node", "left").withColumn("label", label).drop("root")
    groups = known.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("members"))
    main = groups.groupBy("unit").agg(F.max_by("label", F.struct("members", "label")).alias("main"))
    known = known.join(main, "unit").withColumn("loose", F.col("label") != F.col("main")).drop("main")
    spread = known.groupBy("unit", "cell").agg(F.ceil(F.greatest(F.sum(F.col("loose").cast("long")) / TILE_SETS, F.sum(F.when(F.col("loose"), F.col("n")).otherwise(0)) * 8 / TILE_BYTES)).cast("int").alias("parts"))
    known = known.join(_beside(spread, "parts"), ["unit", "cell"])
    part = F.pmod(F.xxhash64(F.lit(1), "node"), F.greatest("parts", F.lit(1))).cast("int")
    rows = known.select("unit", "node", "label", "set", "cell", "tile", "loose", part.alias("part"), _around("parts").alias("asked_by"), _around("tiles").alias("asking"))
    columns = ["unit", "node", "label", "set"]
    other = rows.select(*columns, F.explode("asked_by").alias("p"), F.col("cell").alias("of"), F.col("tile").alias("at"), F.lit(False).alias("asks"))
    own = rows.where("loose").select(*columns, F.explode("asking").alias("p"), "cell", "part", F.lit(True).alias("asks"))
    met = other.select(*columns, F.col("p.cell").alias("cell"), F.col("p.tile").alias("part"), "of", "at", "asks").unionByName(own.select(*columns, "cell", "part", F.col("p.cell").alias("of"), F.col("p.tile").alias("at"), "asks"))
    return met.groupBy("unit", "cell", "part", "of", "at").applyInArrow(lambda table: _compared(table, t), "u long, v long")


def shingle_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 4, percent: int = 85, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Two texts link when 100 * |A & B| >= percent * |A | B| over their sets of `width`-word shingles
    (a text of fewer words is one shingle). component_id is the least id reachable by links. A null,
    empty or blank text has no shingles and is alone; equal sets always link. Rows with a null id
    keep it, link as others do and never name a component: in one without any id it is null. Rows
    stay one to one, repeated ones included. Other columns are not read.
    """
    t = Threshold(percent)
    session = docs.sparkSession
    checkpoints(session)
    buckets = buckets or max(16, 4 * int(session.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    known = stored(describe(docs, width))
    # a set's row: of its texts the one with the least id, if any has one
    row = F.min(F.struct(F.col("id").isNull().alias("_none"), "id", "mark"))
    names = known.where("node is not null").groupBy("node").agg(row.alias("row"), F.min("n").alias("n")).select("node", "n", F.col("row.id").alias("least"), F.col("row.mark").alias("mark"))
    units = connected_components(_units(docs, known, width, t, buckets)).withColumnRenamed("root", "unit")
    members = _cells(units.join(names, "node"), t).checkpoint()
    sets = _with_sets(docs, members, width)
    several = not members.where("large").isEmpty()
    if several:
        sets = sets.checkpoint()
    pivot = F.col("large") & F.array_contains("pivots", F.col("node"))
    own = F.array(F.struct("cell", "tile"))
    first = sets.withColumn("p", F.explode(F.when(pivot, F.array_union(own, _around("tiles"))).otherwise(own)))
    first = first.select("unit", "node", "set", "p.cell", "p.tile", F.col("node").alias("label"), F.lit(False).alias("asks"))
    links = first.groupBy("unit", "cell", "tile").applyInArrow(lambda table: _compared(table, t), "u long, v long")
    roots = connected_components(links)
    if several:
        roots = roots.checkpoint()
        roots = connected_components(_second(sets, roots, t).unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    grouped = names.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")).checkpoint()
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = grouped.join(least, "root").select("node", "component_id")
    return known.drop("point").join(classes, "node", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
