"""Small files and directories beside the data, through Hadoop's file systems, so that any that Spark writes to will do."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> Any | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: Any) -> None:
        """A new file: written beside, then renamed, so that it is there whole or not at all. One that is there is an error."""
        beside, at = self._path(name + ".new"), self._path(name)
        self.fs.mkdirs(at.getParent())
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        if self.fs.exists(at) or not self.fs.rename(beside, at):
            raise OSError(f"can't write {name}")

    def numbered(self, folder: str) -> list[int]:
        """The numbers of the files that write_next() has written."""
        return [int(n.partition(".")[0]) for n in self.names(folder) if n.endswith(".json")]

    def latest(self, folder: str) -> Any | None:
        found = self.numbered(folder)
        return self.read(f"{folder}/{found[-1]:012d}.json") if found else None

    def write_next(self, folder: str, value: Any) -> None:
        """The next value of what latest() reads. No file is replaced or removed, so whoever dies here leaves the value before."""
        self.write(f"{folder}/{max([0, *self.numbered(folder)]) + 1:012d}.json", value)
