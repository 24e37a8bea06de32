"""Files and tables in the folder that driver and executors share.

The folder is the cluster's ``spark.checkpoint.dir``; a temporary one is set
only where that is unset and the master is local.  Files appear under their
final name only when complete, so that a lost or repeated task does no harm.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from contextvars import ContextVar
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary one that becomes the session's checkpoint folder."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strataq-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A folder name of its own in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """Removes the tables that ``kept`` makes inside when it ends, but for those handed to ``keep``, which an outer scope then has."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.stay = spark, [], []

    def __enter__(self) -> Scope:
        self.outer = _SCOPE.get()
        _SCOPE.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _SCOPE.set(self.outer)
        drop(self.spark, *(p for p in self.paths if p not in self.stay))
        if self.outer is not None:
            self.outer.paths += self.stay

    def keep(self, table: tuple[DataFrame, str]) -> DataFrame:
        """The table that ``kept`` gave, which stays."""
        self.stay.append(table[1])
        return table[0]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, what: str, by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read again (this cuts its lineage), and its folder.

    The write's own shuffle files go as soon as it is done, as nothing reads them again. With ``by`` each value of that
    column has a folder of its own, ``by=value``, which may be dropped alone."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    if (scope := _SCOPE.get()) is not None:
        scope.paths.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes folders of the shared folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _local(uri: str) -> str | None:
    at = urlparse(uri)
    return unquote(at.path) if at.scheme in ("", "file") else None


def put(uri: str, chunks: Iterable[bytes]) -> int:
    """Writes a file whole or not at all; gives its size."""
    total, local = 0, _local(uri)
    if local is None:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(uri)
        part = f"{path}.{uuid.uuid4().hex}.part"
        files.create_dir(os.path.dirname(path), recursive=True)
        with files.open_output_stream(part) as out:
            for chunk in chunks:
                total += len(chunk)
                out.write(chunk)
        files.move(part, path)
        return total
    os.makedirs(os.path.dirname(local), exist_ok=True)
    part = f"{local}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as out:
            for chunk in chunks:
                total += len(chunk)
                out.write(chunk)
        os.replace(part, local)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return total


def opened(uri: str):
    """The file for reading, with seek."""
    local = _local(uri)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)
