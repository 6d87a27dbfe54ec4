"""Delivery semantics on streams: dedup, retries with back-off, exactly-once projection, job states, expiry.

Functions take batch or streaming DataFrames alike unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from philolog.sources.sinks import exists

#: Fixed: first delay and longest delay in seconds, doublings at most, attempts before a message is dead, days kept.
FIRST_DELAY, LONGEST_DELAY, DOUBLINGS, ATTEMPTS, KEPT_DAYS = 5, 3600, 10, 12, 7
#: Fixed: redelivery of results.
RESULT_DELAY, RESULT_ATTEMPTS = 5, 8


def retry_delay(attempt: Column, first: int = FIRST_DELAY, longest: int = LONGEST_DELAY) -> Column:
    """Seconds before the next try after a number of attempts."""
    return F.least(F.lit(longest), first * F.pow(F.lit(2), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(DOUBLINGS)))).cast("long")


def after_failure(events: DataFrame, now: Column) -> DataFrame:
    """Counts a failed attempt: pending again after the delay, or dead after the last."""
    n = F.col("attempt_count") + 1
    dead = n >= ATTEMPTS
    return events.select(*[c for c in events.columns if c not in ("attempt_count", "status", "available_at", "locked_until")], n.alias("attempt_count"), F.when(dead, "dead").otherwise("pending").alias("status"), F.when(dead, F.col("available_at")).otherwise(F.timestamp_seconds(F.unix_timestamp(now) + retry_delay(n))).alias("available_at"), F.lit(None).cast("timestamp").alias("locked_until"))


def claimable(events: DataFrame, now: Column) -> DataFrame:
    """Pending events that are due, and published ones whose lease has run out."""
    return events.where(((F.col("status") == "pending") & (F.col("available_at") <= now)) | ((F.col("status") == "publishing") & (F.col("locked_until") < now)))


def replayed(events: DataFrame, now: Column) -> DataFrame:
    """Dead events become pending again."""
    dead = F.col("status") == "dead"
    return events.withColumns({"status": F.when(dead, "pending").otherwise(F.col("status")), "attempt_count": F.when(dead, 0).otherwise(F.col("attempt_count")), "available_at": F.when(dead, now).otherwise(F.col("available_at")), "replay_count": F.col("replay_count") + dead.cast("int")})


def kept(events: DataFrame, now: Column, days: int = KEPT_DAYS) -> DataFrame:
    """Without events published longer ago than they are kept."""
    old = (F.col("status") == "published") & (F.col("published_at") < F.timestamp_seconds(F.unix_timestamp(now) - 86400 * days))
    return events.where(~F.coalesce(old, F.lit(False)))


def first_by_key(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Batch: the first event of each key."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def latest_by_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Batch: the last row of each key; order begins with the greatest."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Streaming: each key once, as far back as the watermark reaches."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def project_once(batch: DataFrame, path: str, id_col: str = "message_id", payload_col: str = "payload", *, buckets: int = 64) -> DataFrame:
    """Adds a micro-batch to a stored table once; gives back messages whose id is known with another payload.

    For foreachBatch of one query, whose batches follow each other: a batch that comes again adds
    nothing. The table is split by a hash of the id, so a batch reads ids of its own buckets alone.
    """
    spark = batch.sparkSession
    new = batch.withColumn("payload_sha256", F.sha2(payload_col, 256)).withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int"))
    new = first_by_key(new, id_col, "payload_sha256")
    if not exists(spark, path):
        new.limit(0).write.partitionBy("bucket").parquet(path)
    stored = spark.read.schema(new.schema).parquet(path)
    mine = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # `buckets` at most
    known = stored.where(F.col("bucket").isin(mine)).select(id_col, F.col("payload_sha256").alias("_sha"))
    # rows added below never differ from the batch, so this holds before and after
    other = new.join(known, id_col).where("_sha != payload_sha256").drop("_sha", "bucket")
    new.join(known, id_col, "left_anti").write.mode("append").partitionBy("bucket").parquet(path)
    return other


#: Fixed: which states a job may pass to.
TRANSITIONS = {"queued": ("running", "cancelled"), "running": ("succeeded", "failed", "cancelled", "queued"), "succeeded": (), "failed": (), "cancelled": ()}


def next_state(state: Column, wanted: Column) -> Column:
    """The wanted state if it may follow, else the old one."""
    out = state
    for old, after in TRANSITIONS.items():
        if after:
            out = F.when((state == old) & wanted.isin(*after), wanted).otherwise(out)
    return out


def job_states(events: DataFrame, part: Column) -> DataFrame:
    """Batch: job_id and final state after events (job_id, seq, wanted), from queued.

    `part` rises with seq and cuts a job's events into parts of bounded size (such as hours). A part
    becomes a map from the state before it to the state after it, and a job's maps are put together.
    """
    states = F.array(*map(F.lit, TRANSITIONS))
    of_part = events.groupBy("job_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "wanted"))).alias("e"))
    moved = F.map_from_arrays(states, F.transform(states, lambda old: F.aggregate("e", old, lambda s, x: next_state(s, x["wanted"]))))
    of_job = of_part.select("job_id", "part", moved.alias("moved")).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("part", F.map_values("moved").alias("to")))).alias("m"))
    return of_job.select("job_id", F.aggregate("m", F.lit("queued"), lambda s, x: F.element_at(x["to"], F.array_position(states, s).cast("int"))).alias("state"))


def restored(jobs: DataFrame) -> DataFrame:
    """After a restart running jobs are queued again."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "queued").otherwise(F.col("state")))


def expired(rows: DataFrame, now: Column, at: str = "expires_at") -> DataFrame:
    return rows.where(F.col(at).isNotNull() & (F.col(at) <= now))


def windowed_counts(stream: DataFrame, time: str = "ts", length: str = "1 hour", delay: str = "1 hour", *keys: str) -> DataFrame:
    """Extension: counts and sums per event-time window; late rows beyond the watermark are dropped."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Extension: sessions of a key, ended by a gap."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def merged_summary(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Running audit totals: pairs, anomalies, confidence sum and count; the mean follows from these."""
    return old.unionByName(batch).groupBy().agg(*[F.sum(c).alias(c) for c in ("pairs", "anomalies", "confidence_sum", "confidence_count")])
