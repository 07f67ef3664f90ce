"""The files under a root: listing, moving and marking, in whatever store they lie.

Goes to Hadoop's file systems through the driver's JVM, so a Spark Connect session cannot use it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """Paths are relative to ``root``. Moving is a rename: on a store that renames in one step a reader sees the old file or the new one."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def children(self, name: str) -> list[str]:
        """Names of the entries of a folder, apart from those Spark does not read."""
        if not self.exists(name):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path(name)))]
        return sorted(n for n in names if n[0] not in "._")

    def matching(self, pattern: str) -> list[str]:
        """Relative paths that match a glob."""
        found = self._fs.globStatus(self._path(self.path(pattern))) or []
        depth = pattern.count("/") + 1
        return sorted("/".join(s.getPath().toString().split("/")[-depth:]) for s in found)

    def move(self, name: str, to: str) -> None:
        target = self._path(self.path(to))
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(self.path(name)), target):
            raise OSError(f"cannot move {self.path(name)} to {self.path(to)}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)

    def create(self, name: str) -> None:
        """A folder, if it is not there."""
        self._fs.mkdirs(self._path(self.path(name)))

    def mark(self, name: str) -> None:
        """An empty file."""
        self._fs.create(self._path(self.path(name)), True).close()
