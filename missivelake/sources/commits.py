"""Commit files: a folder's step counts once an empty file with its name is there."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one where it is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Commits:
    """Files and folders below one folder, in any storage that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, folder: str) -> list[str]:
        store, path = self._path(folder)
        return [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []

    def mark(self, name: str) -> None:
        store, path = self._path(name)
        store.create(path, True).close()

    def folder_of(self, name: str) -> str:
        """A folder's path; it is made if it isn't there, so that it can be read while it is empty."""
        store, path = self._path(name)
        store.mkdirs(path)
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        store, path = self._path(name)
        return store.exists(path)

    def generation(self) -> int:
        return max((int(n) for n in self.names("generations")), default=0)
