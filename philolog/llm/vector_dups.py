"""Embedding near-dedup: links between vectors of one label whose cosine reaches a threshold.

Method: collision-counting projections. A unit vector has a number on each of many random lines. Two
vectors of the threshold's cosine differ on a line by about sqrt(2 - 2 cosine) times a normal variate,
so the window round a query's number that is WINDOW times as wide holds its partner on most lines.
Each line is sorted, the windows' entries are counted for each pair, and pairs counted on at least
`least_count` lines are verified by cosine in double precision. least_count is the greatest count
that a pair at the threshold reaches with probability RECALL.

Equal vectors are one node first. Nodes are cut into cells along one more line, as wide as a pair at
the threshold can be apart (CELL deviations), and cells into tiles of bounded size; a tile meets the
tiles of its own cell and of the next. A task gives back counts of links and a forest of them, never
the pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from philolog.llm import _bytes
from philolog.llm._session import checkpoints
from philolog.llm.components import connected_components
from philolog.llm.shingle_join import Forest

#: Lines; half a window and a cell in deviations of a pair at the threshold; chance that such a pair is verified.
LINES, WINDOW, CELL, RECALL = 24, 1.5, 4.0, 0.99995
#: Nodes of a tile.
TILE = 2048


@lru_cache(maxsize=16)
def lines(dim: int) -> np.ndarray:
    """Random directions, one a row; the first is for the cells."""
    return np.random.default_rng(dim).standard_normal((LINES + 1, dim))


def least_count() -> int:
    p = math.erf(WINDOW / math.sqrt(2))
    tail, k = 0.0, LINES + 1
    while tail < RECALL and k > 0:
        k -= 1
        tail += math.comb(LINES, k) * p**k * (1 - p) ** (LINES - k)
    return k


def _names(x: np.ndarray, labels: list) -> np.ndarray:
    """64-bit names of rows of scaled vectors and their labels; rows with equal numbers and labels have equal names."""
    bits = (x + 0.0).view(np.uint64)
    marks = _bytes.mix(np.arange(1, x.shape[1] + 1, dtype=np.uint64))
    of_label = {v: xxhash.xxh64_intdigest(repr(v)) for v in set(labels)}
    sums = _bytes.mix(bits * (marks | np.uint64(1)) + marks).sum(1, dtype=np.uint64)
    return _bytes.mix(_bytes.mix(sums) + np.array([of_label[v] for v in labels], np.uint64)).view(np.int64)


def _named(batches, deviation: float):
    """(vec_id, label, node, dim, cell, unit): the last four are null for vectors that link with nothing."""
    for batch in batches:
        lists, labels = batch.column(2), np.array(batch.column(1).to_pylist(), object)
        offsets, flat = lists.offsets.to_numpy(), lists.values
        absent = np.concatenate(([0], np.cumsum(np.asarray(flat.is_null()))))
        values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy()
        length = np.diff(offsets)
        able = np.asarray(lists.is_valid()) & (length > 0) & (absent[offsets[1:]] == absent[offsets[:-1]]) & np.array([v is not None for v in labels], bool)
        nodes, dims, cells, units = (np.full(len(lists), None, object) for _ in range(4))
        for dim in np.unique(length[able]).tolist():
            rows = np.flatnonzero(able & (length == dim))
            x = values[offsets[rows][:, None] + np.arange(dim)]
            scale = np.abs(x).max(1)
            good = np.isfinite(scale) & (scale > 0)
            rows, x = rows[good], x[good] / scale[good, None]
            if len(rows):
                nodes[rows] = _names(x, labels[rows].tolist())
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                dims[rows] = dim
                cells[rows] = np.floor(x @ lines(dim)[0] / (CELL * deviation)).astype(np.int64)
                units[rows] = np.array([u.tobytes() for u in x], object)
        columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(dims, pa.int32()), pa.array(cells, pa.int32()), pa.array(units, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "node", "dim", "cell", "unit"])


def linked(a: np.ndarray, b: np.ndarray, least: float):
    """(i, all j with a link) for rows i of a and j of b."""
    half = WINDOW * math.sqrt(2 - 2 * least)
    need = least_count()
    directions = lines(a.shape[1])[1:]
    on_a, on_b = a @ directions.T, b @ directions.T
    orders = [np.argsort(on_b[:, k], kind="stable") for k in range(LINES)]
    low = np.stack([np.searchsorted(on_b[o, k], on_a[:, k] - half, "left") for k, o in enumerate(orders)], 1)
    high = np.stack([np.searchsorted(on_b[o, k], on_a[:, k] + half, "right") for k, o in enumerate(orders)], 1)
    for i in range(len(a)):
        counts = np.zeros(len(b), np.int8)
        for k, order in enumerate(orders):
            counts[order[low[i, k] : high[i, k]]] += 1
        near = np.flatnonzero(counts >= need)
        yield i, near[b[near] @ a[i] >= least]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Rows link when their labels are equal and not null, their lengths are equal and their cosine is
    at least `least`. A vector that is null, empty, zero or has a null or non-finite component links
    with nothing. Equal vectors always link. component_id is the least id reachable; a row with a
    null id counts as a link of others but never names a component, and is not kept.
    """
    checkpoints(vectors.sparkSession)
    deviation = math.sqrt(2 - 2 * least)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    known = source.mapInArrow(lambda b: _named(b, deviation), "vec_id long, label string, node long, dim int, cell int, unit binary").checkpoint()
    nodes = known.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("label").alias("label"), F.min("dim").alias("dim"), F.min("cell").alias("cell"), F.min("unit").alias("unit"))
    by_cell = Window.partitionBy("label", "dim").orderBy("cell")

    def beside(step: int):
        at = F.lag if step < 0 else F.lead
        return F.when(at("cell").over(by_cell) == F.col("cell") + step, at("tiles").over(by_cell)).otherwise(0)

    cells = nodes.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    cells = cells.withColumn("before", beside(-1)).withColumn("next", beside(1))
    placed = nodes.join(cells, ["label", "dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def meetings(count: str, low, high, first: int):
        """For the tiles 0 .. count - 1 of a cell: (lower cell, tile there, tile in the higher cell, same cell, own side)."""
        some = F.sequence(F.lit(0), F.col(count) - 1)
        made = F.transform(some, lambda j: F.struct((F.col("cell") + first).alias("of"), low(j).alias("low"), high(j).alias("high"), F.lit(count == "tiles").alias("same")))
        return F.when(F.col(count) > 0, made).otherwise(F.array().cast(made_type))

    made_type = "array<struct<of:int,low:int,high:int,same:boolean>>"
    own = F.col("tile")
    all_meetings = F.concat(
        meetings("tiles", lambda j: F.least(own, j), lambda j: F.greatest(own, j), 0),
        meetings("next", lambda j: own, lambda j: j, 0),
        meetings("before", lambda j: j, lambda j: own, -1),
    )
    spread = placed.withColumn("m", F.explode(all_meetings)).select("label", "dim", "m.*", "node", "copies", "unit", F.when(F.col("m.same"), own == F.col("m.low")).otherwise(F.col("m.of") == F.col("cell")).alias("left"))

    def meet(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        units = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(-1, dim)
        names, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        left = table["left"].to_numpy()
        alone = table["same"][0].as_py() and table["low"][0].as_py() == table["high"][0].as_py()
        rows, others = np.flatnonzero(left), np.flatnonzero(left if alone else ~left)
        links, forest, edges = np.zeros(len(names), np.int64), Forest(len(names)), []
        for i, found in linked(units[rows], units[others], least) if len(rows) and len(others) else ():
            a, bs = int(rows[i]), others[found]
            bs = bs[bs != a]
            links[a] += copies[bs].sum()
            if not alone:
                links[bs] += copies[a]
            edges += [(names[a], names[b]) for b in bs.tolist() if forest.join(a, b)]
        some = np.flatnonzero(links)
        node = np.concatenate((names[some], np.array([a for a, _ in edges], np.int64)))
        other = [None] * len(some) + [int(b) for _, b in edges]
        count = np.concatenate((links[some], np.zeros(len(edges), np.int64)))
        return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64()), "links": pa.array(count, pa.int64())})

    met = spread.groupBy("label", "dim", "of", "low", "high", "same").applyInArrow(meet, "node long, other long, links long").checkpoint()
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(met.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    grouped = nodes.select("node", "first", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_of = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = grouped.join(least_of, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = known.select("vec_id", "node").join(classes, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
