"""Versions of a small state in a folder: what a reader finds is a whole version, and what isn't named in it isn't there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    """A JSON state in numbered files. A version is written beside and renamed, so it is there whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/_manifest"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, version: int):
        return self._hadoop.Path(f"{self.path}/v{version:012d}.json")

    def read(self) -> tuple[int, dict]:
        """The last version and its state; (0, {}) if there is none."""
        folder = self._hadoop.Path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        version = max((int(n[1:13]) for n in names if n.startswith("v")), default=0)
        if not version:
            return 0, {}
        stream = self._fs.open(self._file(version))
        try:
            return version, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, after: int, state: dict) -> None:
        """Makes ``state`` the version that follows ``after``; an error if another writer has made one."""
        beside = self._hadoop.Path(f"{self.path}/.{uuid.uuid4().hex}")
        stream = self._fs.create(beside, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self._fs.exists(self._file(after + 1)) or not self._fs.rename(beside, self._file(after + 1)):
            self._fs.delete(beside, False)
            raise RuntimeError(f"{self.path}: version {after + 1} is another writer's")

    def drop(self, folder: str) -> None:
        """Deletes a folder that no version in use names."""
        self._fs.delete(self._hadoop.Path(folder), True)

    def folders(self, folder: str) -> list[str]:
        """Names of what a folder holds; none if it isn't there."""
        where = self._hadoop.Path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
