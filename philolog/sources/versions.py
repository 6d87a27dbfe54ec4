"""Stored tables published by version: folders that never change, and numbered manifests that name them.

A version's tables are written under a name of their own. Then its manifest, the next number, is put
where no file of that number is yet; whoever comes second loses. Readers take the highest manifest that
is whole, so they meet neither a gap nor a half-written version.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Version:
    """A published version: its number, its folder, and for each table its rows as counted when it was written."""

    number: int
    folder: str
    rows: dict[str, int]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def workspace(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: below spark.checkpoint.dir. A single machine may do without that setting."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="workspace-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put_if_absent(spark: SparkSession, path: str, content: bytes) -> None:
    """Creates a file with this content; raises Conflict if there is one."""
    where, files = _files(spark, path)
    try:
        if files.getScheme() == "file":
            # that file system tests and creates in two steps
            out = os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            with os.fdopen(out, "wb") as file:
                file.write(content)
            return
        out = files.create(where, False)
        out.write(bytearray(content))
        out.close()
    except Exception as problem:
        if isinstance(problem, FileExistsError) or files.exists(where):
            raise Conflict(path) from problem
        raise


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    """Names of all manifests, the newest first."""
    where, files = _files(spark, f"{folder}/manifests")
    if not files.exists(where):
        return []
    return sorted((s.getPath().getName() for s in files.listStatus(where) if s.getPath().getName().endswith(".json")), reverse=True)


def _read(spark: SparkSession, path: str) -> dict | None:
    """A manifest, or None if it isn't whole."""
    where, files = _files(spark, path)
    stream = files.open(where)
    try:
        text = bytes(stream.readAllBytes())
    finally:
        stream.close()
    body, _, mark = text.rpartition(b"\n")
    return json.loads(body) if body and mark == b"%08x" % zlib.crc32(body) else None


def current(spark: SparkSession, folder: str) -> Version | None:
    """The newest whole version, or None."""
    for name in _manifests(spark, folder):
        if found := _read(spark, f"{folder}/manifests/{name}"):
            return Version(found["number"], f"{folder}/{found['folder']}", found["rows"])
    return None


def publish(tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], folder: str, *, after: Version | None = None, partition_by: dict[str, list[str]] | None = None, check: Callable[[dict[str, DataFrame]], None] | None = None, keep: int = 3) -> Version:
    """Writes tables and makes them the folder's newest version. A table may be a function of those written before it.

    `after` is the version that they were made from: if another was published since, this one is
    dropped and Conflict raised. `check` gets the tables as they were written and may raise. Versions
    older than the newest `keep` are deleted. A published version is whole: a table that could not be
    written leaves the one before in place.
    """
    spark = next(iter(tables.values())).sparkSession  # the first is no function
    made = f"versions/{uuid.uuid4().hex}"
    number = 1 + (after.number if after else 0)
    counts, written = {}, {}
    try:
        for name, rows in tables.items():
            rows = rows(written) if callable(rows) else rows
            writer = rows.write
            if by := (partition_by or {}).get(name):
                writer = writer.partitionBy(*by)
            writer.parquet(f"{folder}/{made}/{name}")
            written[name] = spark.read.schema(rows.schema).parquet(f"{folder}/{made}/{name}")
            counts[name] = written[name].count()
        if check:
            check(written)
        where, files = _files(spark, f"{folder}/manifests")
        files.mkdirs(where)
        names = _manifests(spark, folder)
        newest = current(spark, folder)
        if newest and newest.number >= number:
            raise Conflict(f"{folder} has version {newest.number}")
        # numbers of manifests that their writers never finished are passed over
        taken = int(names[0].removesuffix(".json")) if names else 0
        body = json.dumps({"number": max(number, taken + 1), "folder": made, "rows": counts, "at": time.time()}).encode()
        number = max(number, taken + 1)
        _put_if_absent(spark, f"{folder}/manifests/{number:012d}.json", body + b"\n%08x" % zlib.crc32(body))
    except Exception:
        where, files = _files(spark, f"{folder}/{made}")
        files.delete(where, True)
        raise
    _forget(spark, folder, keep)
    return Version(number, f"{folder}/{made}", counts)


def _forget(spark: SparkSession, folder: str, keep: int) -> None:
    """Deletes all versions but the newest `keep`, manifests first."""
    for name in _manifests(spark, folder)[keep:]:
        old = _read(spark, f"{folder}/manifests/{name}")
        for path in (f"manifests/{name}", *((old["folder"],) if old else ())):
            where, files = _files(spark, f"{folder}/{path}")
            files.delete(where, True)
