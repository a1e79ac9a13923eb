"""Small files through Hadoop's file systems, so that a store can lie wherever Spark reads and writes."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


#: What unfinished files end in, and the age from which they are taken for a dead writer's.
TEMPORARY, STALE_SECONDS = ".tmp", 60


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        names = (s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else ()
        return sorted(n for n in names if not n.endswith(TEMPORARY))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_new(self, name: str, data: bytes) -> bool:
        """Writes aside, to a name of its own, syncs and renames; False if the file exists, so that of two writers one wins.

        That rests on the file system: HDFS and local ones refuse to rename onto a file, an object store may not, so there
        a store must have one writer only.
        """
        aside, to = self._path(f"{name}.{uuid.uuid4().hex}{TEMPORARY}"), self._path(name)
        if self.fs.exists(to):
            return False
        out = self.fs.create(aside, False)
        try:
            out.write(data)
            out.hsync()
        finally:
            out.close()
        if self.fs.rename(aside, to):
            return True
        self.fs.delete(aside, False)
        return False

    def sweep(self, folder: str) -> None:
        """Removes what writers that died have left aside."""
        where = self._path(folder)
        if self.fs.exists(where):
            for s in self.fs.listStatus(where):
                if s.getPath().getName().endswith(TEMPORARY) and s.getModificationTime() < (time.time() - STALE_SECONDS) * 1000:
                    self.fs.delete(s.getPath(), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
