"""Writers: exports for spreadsheets, interchange files, manifests, and publication in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from philolog.functions import text as X

#: Fixed: most rows of an export.
EXPORT_ROWS = 100_000


#: A mark at the head of a UTF-8 file by which spreadsheets know the encoding.
BOM = "\ufeff"


def export_table(rows: DataFrame, path: str, most: int = EXPORT_ROWS) -> int:
    """Writes tab-separated text with a header and guarded cells, and gives back the number of rows.

    The rows are worked out once: they are written aside and counted on the way, and take the path's
    place only if they are not more than allowed.
    """
    spark, seen = rows.sparkSession, Observation()
    safe = rows.limit(most + 1).observe(seen, F.count(F.lit(1)).alias("n"))
    cells = [X.spreadsheet_safe(F.col(c).cast("string")).alias(f"{BOM if i == 0 else ''}{c}") for i, c in enumerate(rows.columns)]
    jvm = spark.sparkContext._jvm
    aside, target = jvm.org.apache.hadoop.fs.Path(f"{path}.new-{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    writer = safe.select(*cells).write.option("sep", "\t").option("header", True).option("lineSep", "\r\n").option("encoding", "UTF-8")
    try:
        writer.option("quote", '"').option("escape", '"').option("emptyValue", "").csv(aside.toString())
        n = seen.get["n"]
        if n > most:
            raise ValueError(f"more than {most} rows")
        files.delete(target, True)
        if not files.rename(aside, target):
            raise OSError(f"{path} cannot be replaced")
    finally:
        files.delete(aside, True)
    return n


def write_lines(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON lines folder for each table."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")


def write_manifest(manifest: DataFrame, folder: str) -> None:
    flat = manifest.withColumn("notes", F.array_join("notes", ";")) if dict(manifest.dtypes).get("notes", "").startswith("array") else manifest
    marked = flat.select(*[F.col(c).alias(f"{BOM if i == 0 else ''}{c}") for i, c in enumerate(flat.columns)])
    marked.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/csv")
    manifest.write.mode("overwrite").json(f"{folder}/json")


def publish(rows: DataFrame, path: str) -> None:
    """Replaces a Parquet folder by rows: written aside, then renamed."""
    aside = f"{path}.new-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    replace(rows.sparkSession, aside, path)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts a folder in the place of another by two renames; if the second fails the old folder comes back.

    A store without a rename over folders has a moment between the two in which readers find nothing.
    """
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fresh, target, old = jvm.Path(new), jvm.Path(path), jvm.Path(f"{path}.old-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = files.exists(target)
    if had and not files.rename(target, old):
        raise OSError(f"{path} cannot be set aside")
    if not files.rename(fresh, target):
        if had:
            files.rename(old, target)
        raise OSError(f"{path} cannot be replaced")
    if had:
        files.delete(old, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


#: Fixed: the version that stored indexes of this form carry.
INDEX_VERSION = "1"
#: Tables of a stored index and the columns that queries need.
INDEX_TABLES = {
    "tokens": ("document_id", "sentence_no", "sentence_position", "stream_position", "global_position", "surface", "normalized", "lemma", "pos", "is_punctuation", "document_start", "document_end", "language"),
    "word_totals": ("normalized", "display", "frequency", "document_range", "is_punctuation", "language"),
    "word_frequencies": ("normalized", "pos", "display", "frequency", "document_range", "is_punctuation", "language"),
    "document_streams": ("document_id", "text", "language"),
}


def missing_columns(spark: SparkSession, path: str, wanted: dict[str, str]) -> list[str]:
    """Columns of a stored table that are absent or of another type."""
    have = dict(spark.read.parquet(path).dtypes)
    return sorted(c for c, kind in wanted.items() if have.get(c) != kind)


def index_health(spark: SparkSession, folder: str, version: str = INDEX_VERSION) -> tuple[str, str]:
    """State of a stored index (missing, corrupt, outdated or ready) and what is amiss."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if absent := [t for t in (*INDEX_TABLES, "meta") if not files.exists(path(f"{folder}/{t}"))]:
        return "missing", ", ".join(absent)
    try:
        stored = [r["version"] for r in spark.read.json(f"{folder}/meta").collect()]
    except Exception as problem:  # whatever keeps the one row from being read
        return "corrupt", f"meta: {type(problem).__name__}"
    if stored != [version]:
        return "outdated", f"version {stored[0] if stored else 'unknown'}, not {version}"
    for table, columns in INDEX_TABLES.items():
        try:
            have = spark.read.parquet(f"{folder}/{table}").columns
        except Exception as problem:
            return "corrupt", f"{table}: {type(problem).__name__}"
        if lacking := sorted(set(columns) - set(have)):
            return "corrupt", f"{table} lacks {', '.join(lacking)}"
    return "ready", ""
