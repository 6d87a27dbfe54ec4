"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

Inner products become distances: each candidate gets one more component that makes all of them equally
long, so that the nearest candidates of an anchor are those of the greatest inner product. Pivots part
that space into cells; anchors of a cell are a group. Each group first meets the candidates of its own
cell, which bounds what the best scores of its anchors can be at least. A candidate of another cell is
then sent to the group only if, by its distance to the group's pivot and the group's radius, it might
reach that bound. Groups and what is sent to them are cut into tiles of bounded size, which are joined
exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from philolog.llm._session import stored

#: Positives of an anchor; negatives of an anchor and a positive; their scores in percent of the positive's.
POSITIVES, NEGATIVES, BAND = 5, 3, (50, 95)
#: Components are multiplied by this and floored.
SCALE = 256
#: Anchors for which there is one pivot, and most pivots; anchors and candidates of a tile.
ANCHORS_PER_PIVOT, MOST_PIVOTS, ANCHOR_TILE, TILE = 128, 256, 1024, 8192
#: Rows of a greater squared length take no part, as their scores may not fit a long.
MOST_NORM = 2.0**61


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), dim)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(key, vec_id, label, dim, q, norm) of the rows that take part: q is the vector in integers, packed, and norm its squared length."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            packed, norms = [None] * len(lists), np.zeros(len(lists))
            for k in np.flatnonzero(np.asarray(lists.is_valid())).tolist():
                x = np.floor(values[offsets[k] : offsets[k + 1]] * SCALE)
                norm = float(x @ x)
                if norm < MOST_NORM:  # not so if any component is no finite number
                    packed[k], norms[k] = x.astype(np.int32).tobytes(), norm
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(norms)], ["vec_id", "label", "q", "norm"])

    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and label is not null and vector is not null")
    rows = source.mapInArrow(run, "vec_id long, label string, q binary, norm double").where("q is not null").dropDuplicates(["vec_id", "label", "q"])
    return stored(rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", (F.octet_length("q") / 4).cast("int").alias("dim"), "q", "norm"))


class Pivots:
    """Pivots by dimension, in the space with one component more."""

    def __init__(self, sample: list, norm: float):
        self.norm, self.of = norm, {}
        for dim, q, own in sample:
            self.of.setdefault(dim, []).append(np.append(np.frombuffer(q, np.int32).astype(float), math.sqrt(max(0.0, norm - own))))

    def points(self, dim: int) -> np.ndarray:
        return np.array(self.of.get(dim) or [np.zeros(dim + 1)])

    def distances(self, q: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Of each row, with its component more, to each pivot."""
        points = self.points(q.shape[1])
        rows = np.hstack([q.astype(float), more[:, None]])
        square = (rows**2).sum(1)[:, None] + (points**2).sum(1) - 2 * rows @ points.T
        return np.sqrt(np.maximum(square, 0))


def _by_dim(batch: pa.RecordBatch):
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, _matrix(batch.column("q").take(pa.array(rows)), dim)


def _assigned(rows: DataFrame, pivots: Pivots, anchor: str) -> DataFrame:
    """rows with the nearest pivot as a candidate (cell) and, for anchors, as an anchor (home) with its distance (radius)."""

    def run(batches):
        for batch in batches:
            cell, home, radius = np.zeros(len(batch), np.int32), np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            norms, own = batch.column("norm").to_numpy(), np.asarray(batch.column("own"))
            for _, at, q in _by_dim(batch):
                cell[at] = pivots.distances(q, np.sqrt(np.maximum(pivots.norm - norms[at], 0))).argmin(1)
                some = own[at]
                if some.any():
                    far = pivots.distances(q[some], np.zeros(some.sum()))
                    home[at[some]], radius[at[some]] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(home), pa.array(radius)], [*batch.schema.names, "cell", "home", "radius"])

    source = rows.withColumn("own", F.coalesce(F.expr(anchor).cast("boolean"), F.lit(False)))
    return stored(source.mapInArrow(run, "key long, vec_id long, label string, dim int, q binary, norm double, own boolean, cell int, home int, radius double"))


def _sent(rows: DataFrame, anchors: DataFrame, pivots: Pivots) -> DataFrame:
    """Candidates with the groups (home) outside of their own cell that they might serve.

    anchors have `least` and `most`: scores outside of them are of no use. The bounds of a group, of
    which there are at most as many as pivots, are those of all its anchors.
    """
    found = anchors.groupBy("dim", "home").agg(F.max("radius"), F.max("norm"), F.min("norm"), F.min("least"), F.max("most")).collect()
    groups: dict[int, list] = {}
    for dim, home, *bounds in found:
        groups.setdefault(dim, []).append((home, *bounds))

    def run(batches):
        for batch in batches:
            targets: list[list[int]] = [[] for _ in range(len(batch))]
            norms, cells = batch.column("norm").to_numpy(), batch.column("cell").to_numpy()
            for dim, at, q in _by_dim(batch):
                far = pivots.distances(q, np.sqrt(np.maximum(pivots.norm - norms[at], 0)))
                for home, radius, high, low, least, most in groups.get(dim, ()):
                    slack = 1e-6 * (1 + pivots.norm + high)
                    near = np.maximum(far[:, home] - radius, 0)
                    best, worst = (high + pivots.norm - near**2) / 2 + slack, (low + pivots.norm - (far[:, home] + radius) ** 2) / 2 - slack
                    for k in at[(cells[at] != home) & (best >= least) & (worst <= most)].tolist():
                        targets[k].append(home)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "vec_id", "label", "dim", "q", "norm")), pa.array(targets, pa.list_(pa.int32()))], ["key", "vec_id", "label", "dim", "q", "norm", "homes"])

    sent = rows.mapInArrow(run, "key long, vec_id long, label string, dim int, q binary, norm double, homes array<int>")
    return sent.select("key", "vec_id", "label", "dim", "q", "norm", F.explode("homes").alias("home"))


def _tiles(anchors: DataFrame, candidates: DataFrame, keys: list[str], join) -> DataFrame:
    """join(table) of each tile: (anchor, slot, key, vec_id, score)."""
    blocks = candidates.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    subs = anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ANCHOR_TILE).cast("int").alias("subs"))
    sizes = stored(blocks.join(subs, keys))
    columns = ["key", "vec_id", "label", "q", "norm"]

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        placed = rows.join(sizes, keys).withColumn(f"_{own}", F.pmod(F.xxhash64("key"), F.col(own)).cast("int"))
        return placed.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    names = [*(F.col(k).alias(f"_{k}") for k in keys), "_subs", "_blocks", *columns]
    nothing = F.lit(None).cast("array<long>")
    left = dealt(anchors, "subs", "blocks").select(*names, F.lit(True).alias("own"), "scores", "floor")
    right = dealt(candidates, "blocks", "subs").select(*names, F.lit(False).alias("own"), nothing.alias("scores"), F.lit(None).cast("double").alias("floor"))
    return stored(left.unionByName(right).groupBy(*[f"_{k}" for k in keys], "_subs", "_blocks").applyInArrow(join, "anchor long, slot int, key long, vec_id long, score long"))


def _scores(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Inner products: in floating point where that is exact."""
    if norm_a.max() * norm_b.max() < 2.0**100:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _sides(table: pa.Table):
    """Anchors and candidates of a tile, and their scores, a few anchors at a time."""
    own = np.asarray(table["own"])
    a, b = table.filter(pa.array(own)), table.filter(pa.array(~own))
    if not len(a) or not len(b):
        return
    dim = len(b["q"][0].as_py()) // 4
    x, y, nx, ny = _matrix(a["q"], dim), _matrix(b["q"], dim), a["norm"].to_numpy(), b["norm"].to_numpy()
    key, ids, labels = b["key"].to_numpy(), b["vec_id"].to_numpy(), np.array(b["label"].to_pylist(), object)
    keys, own_labels, floors, bands = a["key"].to_numpy(), a["label"].to_pylist(), a["floor"].to_numpy(), a["scores"].to_pylist()
    for lo in range(0, len(a), 128):
        scores = _scores(x[lo : lo + 128], y, nx[lo : lo + 128], ny)
        for i, row in enumerate(scores, lo):
            yield keys[i], own_labels[i], floors[i], bands[i], row, key, ids, labels


def _result(rows: list) -> pa.Table:
    kinds = [("anchor", pa.int64()), ("slot", pa.int32()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})


def _best(row: np.ndarray, ids: np.ndarray, able: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest of the scores at `able`, ties by id."""
    if len(able) > 4 * n:
        able = able[row[able] >= np.partition(row[able], len(able) - n)[len(able) - n]]
    return able[np.lexsort((ids[able], -row[able]))][:n]


def mine(vectors: DataFrame, anchor: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors that the SQL condition `anchor` on vec_id names.

    Scores are inner products of the vectors in integers. An anchor's positives are the first other
    rows of its label, by falling score, then id. Of the rows of other labels whose score is at least
    band[0] and at most band[1] percent of the positive's, the first are its negatives. Rows with a
    null id, label or vector, or a component that is null or not finite, or too long for scores that
    fit, take no part; rows equal in id, label and vector count once. Only vectors of equal length
    meet. An anchor without positives, and a positive without negatives, give no row.
    """
    low, high = band
    rows = whole_vectors(vectors, id_col, vector_col, label_col)
    n, norm = rows.where(anchor).count(), rows.agg(F.max("norm")).first()[0] or 0.0
    some = rows.orderBy(F.xxhash64("vec_id"), "key").limit(min(MOST_PIVOTS, math.ceil(n / ANCHORS_PER_PIVOT) or 1))
    pivots = Pivots(some.select("dim", "q", "norm").collect(), norm)
    rows = _assigned(rows, pivots, anchor)
    home = rows.withColumn("home", F.col("cell"))
    anchors = rows.where("own").withColumn("scores", F.lit(None).cast("array<long>")).withColumn("floor", F.lit(-math.inf))

    def alike(table: pa.Table) -> pa.Table:
        out = []
        for own, _, floor, _, row, key, ids, _ in _sides(table):
            for k in _best(row, ids, np.flatnonzero((row >= floor) & (key != own)), positives).tolist():
                out.append((own, 0, key[k], ids[k], row[k]))
        return _result(out)

    def unlike(table: pa.Table) -> pa.Table:
        out = []
        for own, label, floor, scores, row, key, ids, labels in _sides(table):
            able = np.flatnonzero((row >= floor) & (100 * row <= high * max(scores)) & (labels != label))
            for slot, score in enumerate(scores):
                fit = able[(100 * row[able] <= high * score) & (100 * row[able] >= low * score)]
                for k in _best(row, ids, fit, negatives).tolist():
                    out.append((own, slot, key[k], ids[k], row[k]))
        return _result(out)

    def first(found: DataFrame, n: int) -> DataFrame:
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "key")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    groups = ["dim", "home", "label"]
    near = _tiles(anchors, home, groups, alike)
    bound = first(near, positives).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    bound = bound.where(F.col("n") == positives).select(F.col("anchor").alias("key"), F.col("worst").cast("double").alias("floor"))
    anchors = stored(anchors.drop("floor").join(bound, "key", "left").na.fill({"floor": -math.inf}).withColumn("least", F.col("floor")).withColumn("most", F.lit(math.inf)))
    far = _tiles(anchors, _sent(rows, anchors, pivots), groups, alike)
    chosen = stored(first(near.unionByName(far), positives).select("anchor", (F.col("rank") - 1).cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    by_slot = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    anchors = stored(anchors.drop("scores", "floor", "least", "most").join(by_slot.withColumnRenamed("anchor", "key"), "key").withColumn("floor", F.lit(-math.inf)))
    near = _tiles(anchors, home, ["dim", "home"], unlike)
    full = first(near, negatives).groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).where(F.col("n") == negatives)
    floors = chosen.join(full, ["anchor", "slot"], "left").groupBy("anchor").agg(F.min(F.coalesce(F.col("worst").cast("double"), F.floor(F.col("positive_score") * low / 100).cast("double"))).alias("floor"))
    ceiling = F.array_max("scores") * high / 100
    anchors = stored(anchors.drop("floor").join(floors.withColumnRenamed("anchor", "key"), "key").withColumn("least", F.col("floor")).withColumn("most", F.ceil(ceiling).cast("double")))
    far = _tiles(anchors, _sent(rows, anchors, pivots), ["dim", "home"], unlike)
    found = first(near.unionByName(far), negatives).join(chosen, ["anchor", "slot"]).join(anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
