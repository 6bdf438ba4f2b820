"""Folders that all executors can read."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; in local mode without that setting a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share, or name one")
        top = Path(tempfile.mkdtemp(prefix="forkline-")).as_uri()
    return f"{top}/database-{uuid.uuid4().hex}"


class Folder:
    """A folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def _at(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.conf), p

    def write_text(self, name: str, text: str) -> None:
        """A new generation of the file, finished before it gets its name, and only then are
        older ones deleted: whenever this is broken off, read_text() finds a whole file."""
        fs, _ = self._at(name)
        had = self._generations(name)
        number = had[-1] + 1 if had else 1
        _, new = self._at(f"{name}.{number}.new")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(new, self._at(f"{name}.{number}")[1]):
            raise OSError(f"{self.path(name)} can't be written")
        for old in had:
            fs.delete(self._at(f"{name}.{old}")[1], False)

    def _generations(self, name: str) -> list[int]:
        fs, root = self._at(name)
        if not fs.exists(root.getParent()):
            return []
        found = (f.getPath().getName() for f in fs.listStatus(root.getParent()))
        return sorted(int(n[len(name) + 1 :]) for n in found if n.startswith(f"{name}.") and n[len(name) + 1 :].isdigit())

    def read_text(self, name: str) -> str:
        had = self._generations(name)
        if not had:
            raise FileNotFoundError(self.path(name))
        fs, p = self._at(f"{name}.{had[-1]}")
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)
