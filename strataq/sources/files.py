"""Small files and folders on whatever file system Spark has, through Spark's own client."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one if that is unset and the master is local."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strataq-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


class Files:
    """A few operations of Hadoop's file system interface."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it is missing."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def size(self, path: str) -> int:
        """Bytes of all files below."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def modified(self, path: str) -> float:
        """When it was last changed, in seconds."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def rename_new(self, path: str, to: str) -> bool:
        """Renames a folder to a name that must be free; whether it was."""
        fs, p = self._at(path)
        target = self.jvm.org.apache.hadoop.fs.Path(to)
        return not fs.exists(target) and fs.rename(p, target)

    def local(self, path: str) -> str | None:
        """The path on this machine, if it is on its own file system."""
        fs, p = self._at(path)
        return fs.makeQualified(p).toUri().getPath() if fs.getScheme() == "file" else None

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """Writes a file that must not exist: first beside it, then under its name in one step, which only one writer can take."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        if (local := self.local(path)) is not None:
            beside = local + part[len(path) :]
            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(beside, "w", encoding="utf-8") as out:
                out.write(text)
            try:
                os.link(beside, local)
            finally:
                os.unlink(beside)
            return
        fs, p = self._at(path)
        at = self.jvm.org.apache.hadoop.fs.Path(part)
        stream = fs.create(at, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(p) or not fs.rename(at, p):
            fs.delete(at, False)
            raise FileExistsError(path)


class Appender:
    """A new file that grows; what is written is with the file system when ``write`` returns."""

    def __init__(self, files: Files, path: str) -> None:
        self.path, self.file, self.stream = path, None, None
        if (local := files.local(path)) is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            self.file = open(local, "xb", buffering=0)
        else:
            fs, p = files._at(path)
            self.stream = fs.create(p, False)

    def write(self, data: bytes) -> None:
        if self.file is not None:
            self.file.write(data)
        else:
            self.stream.write(bytearray(data))
            self.stream.hflush()

    def close(self) -> None:
        (self.file or self.stream).close()
