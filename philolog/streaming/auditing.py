"""An audit of aligned pairs that come in batches.

What earlier batches tell about later ones is the first number of each distinct pair, from which the
first target of a source follows. It is kept in a table split by a hash of the source, as digests, one
folder for each batch; a batch reads the buckets of its own sources. Flags and counts are written by
batch too, so a batch that comes again replaces what it wrote, and reads nothing of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from philolog.operators import parallel
from philolog.sources.sinks import exists

_STATE = "batch long, bucket int, a string, b string, first_pair long"
_FLAGS = "batch long, pair_no long, confidence double, reasons array<string>, length_ratio double"
_COUNTS = {"empty_side": "empty_side_pairs", "duplicate_pair": "duplicate_pairs", "source_translation_variant": "translation_variants", "invalid_confidence": "invalid_confidence_pairs", "low_confidence": "low_confidence_pairs", "length_ratio_outlier": "length_ratio_outliers"}
_SUMS = ", ".join(f"{c} long" for c in ("total_pairs", *_COUNTS.values(), "anomalous_pairs", "good"))


def _digest(column: str) -> Column:
    """64 hexadecimal digits; an empty side stays empty."""
    return F.when(F.col(column) == "", F.lit("")).otherwise(F.sha2(column, 256))


@dataclass
class Audit:
    """An audit whose state lies in a folder that the driver and all executors share.

    Batches are numbered by the one that feeds them, in rising order; pairs of a later batch have
    higher numbers, or else an earlier flag is not taken back: then a pair is judged by what had come
    when it did. `buckets` must stay what it was when the folder was begun.
    """

    spark: SparkSession
    folder: str
    buckets: int = 64
    low: float = parallel.LOW_CONFIDENCE
    least: float = parallel.MIN_RATIO
    most: float = parallel.MAX_RATIO

    def _stored(self, name: str, schema: str) -> DataFrame:
        """A table over all batches; empty before the first."""
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _put(self, rows: DataFrame, name: str, batch: int, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}/batch={batch}") if by else rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def add(self, pairs: DataFrame, batch: int) -> None:
        """Audits a batch against all batches of lower numbers and keeps what it finds."""
        rows = parallel.audit_rows(pairs).withColumn("a", _digest("a")).withColumn("b", _digest("b"))
        bucket = F.pmod(F.xxhash64("a"), F.lit(self.buckets)).cast("int")
        own = parallel.first_pairs(rows).withColumn("bucket", bucket)
        mine = [r[0] for r in own.select("bucket").distinct().collect()]  # `buckets` at most
        before = self._stored("first", _STATE).where((F.col("batch") < batch) & F.col("bucket").isin(mine)).select("a", "b", "first_pair")
        # of the state, what belongs to the batch's sources
        before = before.join(own.select("a").distinct(), "a", "left_semi")
        known = own.select("a", "b", "first_pair").unionByName(before).groupBy("a", "b").agg(F.min("first_pair").alias("first_pair"))
        rows = rows.join(known, ["a", "b"], "left").join(parallel.first_targets(known), "a", "left")
        self._put(parallel.flagged(rows, self.low, self.least, self.most), "flags", batch)
        found = self.spark.read.schema(_FLAGS.removeprefix("batch long, ")).parquet(f"{self.folder}/flags/batch={batch}")
        having = [F.coalesce(F.sum(F.array_contains("reasons", k).cast("long")), F.lit(0)).alias(v) for k, v in _COUNTS.items()]
        good = F.col("confidence").between(0, 1)
        counts = found.agg(F.count(F.lit(1)).alias("total_pairs"), *having, F.coalesce(F.sum((F.size("reasons") > 0).cast("long")), F.lit(0)).alias("anomalous_pairs"), F.coalesce(F.sum(good.cast("long")), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(good, F.col("confidence"))), F.lit(0.0)).alias("confidence"))
        self._put(counts, "counts", batch)
        # last: a batch that stopped before this comes again and finds the state as it was
        self._put(own.join(before, ["a", "b"], "left_anti").select("bucket", "a", "b", "first_pair"), "first", batch, "bucket")

    def flags(self) -> DataFrame:
        """pair_no, confidence, reasons, length_ratio of all batches."""
        return self._stored("flags", _FLAGS).drop("batch")

    def anomalies(self, most: int = parallel.MAX_ANOMALIES) -> DataFrame:
        return parallel.first_anomalies(self.flags(), most)

    def summary(self, most: int = parallel.MAX_ANOMALIES) -> DataFrame:
        """One row with the columns of parallel.audit_summary(), from the batches' counts alone."""
        counts = self._stored("counts", f"batch long, {_SUMS}, confidence double")
        names = ["total_pairs", *_COUNTS.values(), "anomalous_pairs"]
        sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*names, "good")], F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("confidence"))
        flagged = F.col("anomalous_pairs")
        return sums.select(*names, F.least(flagged, F.lit(most)).alias("written_anomalies"), F.greatest(flagged - most, F.lit(0)).alias("suppressed_anomalies"), F.round(F.when(F.col("good") > 0, F.col("confidence") / F.nullif("good", F.lit(0))), 6).alias("mean_confidence"))

    def compact(self, before: int) -> None:
        """Puts the state of all batches below a number into one folder, so that a long stream's batches don't read ever more files.

        The folder is that of the last of them. If this stops between its two steps, pairs are there
        twice, which changes no minimum.
        """
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path(f"{self.folder}/first"))]
        numbers = sorted(n for n in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if n < before)
        old = self._stored("first", _STATE).where(F.col("batch") < before)
        if len(numbers) < 2:
            return
        aside = f"{self.folder}/first.compacting"
        old.groupBy("bucket", "a", "b").agg(F.min("first_pair").alias("first_pair")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(aside)
        self._put(self.spark.read.schema(_STATE.removeprefix("batch long, ")).parquet(aside), "first", numbers[-1], "bucket")
        for folder in (aside, *(f"{self.folder}/first/batch={n}" for n in numbers[:-1])):
            files.delete(path(folder), True)

    def start(self, stream: DataFrame, checkpoint: str, every: int = 50, **options) -> StreamingQuery:
        """Feeds the audit from a stream of pairs; options go to the trigger. After `every` batches the state is compacted."""

        def feed(batch: DataFrame, number: int) -> None:
            self.add(batch, number)
            if number and number % every == 0:
                self.compact(number)

        writer = stream.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint)
        return (writer.trigger(**options) if options else writer).start()
