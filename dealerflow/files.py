"""Files of a folder in whatever store it lies, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """Operations on the entries of one folder; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self._store = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self._path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._store.exists(self._of(name))

    def names(self, pattern: str) -> list[str]:
        """Entries that fit a glob pattern, sorted."""
        return sorted(f.getPath().getName() for f in self._store.globStatus(self._of(pattern)) or [])

    def remove(self, name: str) -> None:
        self._store.delete(self._of(name), True)

    def move(self, name: str, to: str) -> None:
        self._store.mkdirs(self._of(to).getParent())
        if not self._store.rename(self._of(name), self._of(to)):
            raise OSError(f"cannot move {name} to {to} in {self.path}")

    def mark(self, name: str) -> None:
        """Create an empty file."""
        self._store.mkdirs(self._path(self.path))
        if not self._store.createNewFile(self._of(name)):
            raise OSError(f"{name} exists in {self.path}")
