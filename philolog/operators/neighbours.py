"""Approximate nearest neighbours by cosine: an inverted file of cells with product codes.

Vectors are cut to unit length. Cells are the regions of centroids; what a vector lacks from its
centroid is written as one byte for each of its parts. A query looks into the cells of its nearest
centroids only, adds up its products with the codes there from a table of its own, and compares the
best by their whole vectors. How many cells a query looks into is measured when the index is made.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from philolog.operators.retrieval import valid_vector
from philolog.sources import versions

#: Rows that centroids and codes are fitted on; most cells, and rows of the fit for one; values of a part; words of a part's code.
SAMPLE_ROWS, MOST_CELLS, ROWS_PER_CELL, PART, CODES = 20_000, 4096, 24, 4, 256
#: Rounds of a fit; rows whose neighbours measure it; the share of true neighbours that must be found; candidates compared whole, in times of those wanted.
ROUNDS, TRIALS, RECALL, WHOLE = 12, 300, 0.97, 12
#: Vectors and queries of a tile.
TILE, QUERY_TILE = 65_536, 1024


def _centroids(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """Centres of k groups of rows, by rounds of assignment and mean; a group that loses its rows takes one at random."""
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
        centres[~some] = x[draw.integers(0, len(x), (~some).sum())]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[lo : lo + 4096] @ centres.T - half).argmax(1) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def _units(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of one length as rows of unit length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), dim)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Model:
    """Centroids (a row each), codes (part, word, value), and in how many cells a query looks."""

    centroids: np.ndarray
    codes: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows in parts of equal length, the last one filled up with zeros."""
        n = self.codes.shape[0]
        return np.pad(x, ((0, 0), (0, n * PART - x.shape[1]))).reshape(len(x), n, PART)

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the cell and the code."""
        cell = _nearest(x, self.centroids)
        rest = self.parts(x - self.centroids[cell])
        return cell, np.stack([_nearest(rest[:, m], self.codes[m]) for m in range(len(self.codes))], 1).astype(np.uint8)

    def scores(self, query: np.ndarray, bases: float, codes: np.ndarray) -> np.ndarray:
        """About the products of a query with rows of a cell."""
        table = np.einsum("mkp,mp->mk", self.codes, self.parts(query[None])[0])
        return bases + table[np.arange(len(self.codes)), codes].sum(1)

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells that rows look into, the best first, and the rows' products with their centroids."""
        products = x @ self.centroids.T
        order = np.argsort(-products + (self.centroids**2).sum(1) / 2, axis=1, kind="stable")[:, : self.probes]
        return order, np.take_along_axis(products, order, 1)


def fit(sample: np.ndarray, rows: int, *, k: int = 10, recall: float = RECALL) -> Model:
    """A model for `rows` vectors from a sample of them, rows of unit length.

    The neighbours of some rows within the sample, which are farther than those within all rows, are
    sought with ever more cells until the wanted share of them is found.
    """
    draw = np.random.default_rng(17)
    cells = max(1, min(MOST_CELLS, math.isqrt(rows), len(sample) // ROWS_PER_CELL))
    centroids = _centroids(sample, cells, draw)
    model = Model(centroids, np.zeros((-(-sample.shape[1] // PART), 1, PART)), cells)
    rest = model.parts(sample - centroids[_nearest(sample, centroids)])
    words = min(CODES, len(sample))
    model.codes = np.stack([_centroids(rest[:, m], words, draw) for m in range(rest.shape[1])])
    cell, codes = model.encoded(sample)
    trials = sample[draw.permutation(len(sample))[:TRIALS]]
    places, bases = model.probed(trials)
    found, wanted = np.zeros(cells), 0
    for x, own, base in zip(trials, places, bases, strict=True):
        true = np.argsort(-(sample @ x), kind="stable")[: k + 1]
        product = np.zeros(cells)
        product[own] = base
        about = model.scores(x, product[cell], codes)
        rank = np.empty(cells, int)
        rank[own] = np.arange(cells)
        # a neighbour is found from the probe on that opens its cell, if its code then is among the best
        kept = np.argsort(-about, kind="stable")[: WHOLE * (k + 1)]
        for t in np.intersect1d(true, kept).tolist():
            found[rank[cell[t]]] += 1
        wanted += len(true)
    enough = np.flatnonzero(np.cumsum(found) >= recall * wanted)
    model.probes = int(enough[0]) + 1 if len(enough) else cells
    return model


_MODEL = "kind string, part int, place int, values array<double>"


def build(vectors: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", language_col: str | None = None, *, k: int = 10, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> NeighbourIndex:
    """Writes the index as a new version of folder, and opens it.

    All vectors of the sample's most frequent length that are finite and not zero go in, with their
    language if a column has it. Centroids and codes are fitted on at most sample_rows rows, drawn by
    a hash of the ids; how many true neighbours are found is measured there, for k of them.
    """
    spark, before = vectors.sparkSession, versions.current(vectors.sparkSession, folder)
    language = F.col(language_col).cast("string") if language_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), language.alias("language"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    able = rows.where(valid_vector(F.col("vector"), F.size("vector")))
    drawn = able.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toArrow()["vector"].combine_chunks()
    lengths = drawn.value_lengths().to_numpy() if len(drawn) else np.zeros(0, int)
    dim = int(np.bincount(lengths).argmax()) if len(lengths) else 1
    able = able.where(F.size("vector") == dim)
    drawn = drawn.filter(pa.array(lengths == dim)) if len(lengths) else pa.array([[1.0]], pa.list_(pa.float64()))
    model = fit(_units(drawn, dim), able.count(), k=k, recall=recall)

    def run(batches):
        for batch in batches:
            if len(batch):
                x = _units(batch.column(2), dim)
                cell, codes = model.encoded(x)
                columns = [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([u.tobytes() for u in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "language", "cell", "code", "unit"])

    coded = able.mapInArrow(run, "id long, language string, cell int, code binary, unit binary")
    made = [("probes", 0, 0, [float(model.probes)])] + [("centroid", 0, j, c) for j, c in enumerate(model.centroids.tolist())] + [("code", m, j, w) for m, words in enumerate(model.codes.tolist()) for j, w in enumerate(words)]
    tables = {"coded": coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "model": spark.createDataFrame(made, _MODEL).coalesce(1)}
    return opened(spark, folder, versions.publish(tables, folder, after=before))


def opened(spark: SparkSession, folder: str, version: versions.Version | None = None) -> NeighbourIndex:
    version = version or versions.current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"{folder} holds no index")
    found: dict[str, dict] = {"probes": {}, "centroid": {}, "code": {}}
    for kind, part, place, values in version.table(spark, "model").collect():  # MOST_CELLS centroids, CODES words a part
        found[kind][part, place] = values
    words = max(j for _, j in found["code"]) + 1
    codes = np.array([found["code"][key] for key in sorted(found["code"])]).reshape(-1, words, PART)
    return NeighbourIndex(spark, version, Model(np.array([found["centroid"][key] for key in sorted(found["centroid"])]), codes, int(found["probes"][0, 0][0])))


@dataclass
class NeighbourIndex:
    spark: SparkSession
    version: versions.Version
    model: Model

    def search(self, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", *, language: str = "", others: bool = False) -> DataFrame:
        """query_id, rank, id, score: about the k rows of greatest cosine for each query, ties by id.

        With a language, among those of it and of pairs (zh_en). With others, rows of the query's own id
        are left out. Queries of another length, or zero, or not finite, find nothing; each id is asked
        once. Scores are exact, to nine digits; what is approximate is that a neighbour may be missing.
        """
        model, wanted = self.model, WHOLE * (k + others)
        rows = self.version.table(self.spark, "coded")
        rows = rows.where(F.col("language").isin(language, "zh_en")) if language else rows
        asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("query_id is not null and vector is not null")
        asked = asked.where(valid_vector(F.col("vector"), model.dim)).dropDuplicates(["query_id"])

        def placed(batches):
            for batch in batches:
                if len(batch):
                    x = _units(batch.column(1), model.dim)
                    cells, bases = model.probed(x)
                    looks = [[{"cell": int(c), "base": float(b)} for c, b in zip(cs, bs, strict=True)] for cs, bs in zip(cells, bases, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in x], pa.binary()), pa.array(looks, pa.list_(pa.struct([("cell", pa.int32()), ("base", pa.float64())])))], ["query_id", "unit", "looks"])

        looking = asked.mapInArrow(placed, "query_id long, unit binary, looks array<struct<cell:int,base:double>>")
        spread = looking.select("query_id", "unit", F.explode("looks").alias("l")).select("query_id", "unit", "l.cell", "l.base")
        sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
        sizes = sizes.join(spread.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_TILE).cast("int").alias("subs")), "cell")
        sizes = F.broadcast(sizes)  # a row for each cell, MOST_CELLS at most

        def tiles(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
            side = side.join(sizes, "cell").withColumn(f"_{own}", F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
            return side.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

        names = ["cell", "_blocks", "_subs"]
        left = tiles(spread, "query_id", "subs", "blocks").select(*names, F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("unit").alias("data"), "base")
        right = tiles(rows.select("id", "cell", "code"), "id", "blocks", "subs").select(*names, F.lit(False).alias("asks"), "id", F.col("code").alias("data"), F.lit(0.0).alias("base"))

        def meet(table: pa.Table) -> pa.Table:
            asks = np.asarray(table["asks"])
            q, r = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
            out_q, out_id, out_score = [], [], []
            if len(q) and len(r):
                ids = r["id"].to_numpy()
                codes = np.frombuffer(b"".join(r["data"].to_pylist()), np.uint8).reshape(len(r), -1)
                for query, unit, base in zip(q["id"].to_pylist(), q["data"].to_pylist(), q["base"].to_pylist(), strict=True):
                    about = model.scores(np.frombuffer(unit), base, codes)
                    best = np.argpartition(-about, wanted - 1)[:wanted] if len(about) > wanted else np.arange(len(about))
                    out_q.append(np.full(len(best), query))
                    out_id.append(ids[best])
                    out_score.append(about[best])
            none = np.zeros(0)
            return pa.table({"query_id": pa.array(np.concatenate(out_q or [none]).astype(np.int64)), "id": pa.array(np.concatenate(out_id or [none]).astype(np.int64)), "about": pa.array(np.concatenate(out_score or [none]))})

        met = left.unionByName(right).groupBy(*names).applyInArrow(meet, "query_id long, id long, about double")
        met = met.where("query_id != id") if others else met
        by_guess = Window.partitionBy("query_id").orderBy(F.desc("about"), "id")
        best = met.withColumn("_n", F.row_number().over(by_guess)).where(F.col("_n") <= wanted).select("query_id", "id")
        units = best.join(rows.select("id", F.col("unit").alias("there")), "id").join(looking.select("query_id", "unit"), "query_id")

        def compared(batches):
            for batch in batches:
                if len(batch):
                    a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist())).reshape(len(batch), -1) for c in ("unit", "there"))
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array((a * b).sum(1))], ["query_id", "id", "score"])

        scored = units.select("query_id", "id", "unit", "there").mapInArrow(compared, "query_id long, id long, score double").withColumn("score", F.round("score", 9))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
