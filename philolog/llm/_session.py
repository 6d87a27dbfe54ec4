"""Where operators write what must survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder of the session: spark.checkpoint.dir. Where that is unset, one of its own on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def stored(rows: DataFrame) -> DataFrame:
    """rows, written as a compressed Parquet table in the checkpoint folder and read from there: lineage is cut, and columns can be read apart."""
    spark = rows.sparkSession
    path = f"{checkpoints(spark)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this session wrote, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
