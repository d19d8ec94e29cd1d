"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, where it may be unset, a temporary one. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _temporary()).rstrip("/")


@cache
def _temporary() -> str:
    return tempfile.mkdtemp()


class Folder:
    """A folder of any file system that Spark knows, for listing and deleting."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        """Names in the folder or a folder below it, in order; none if it isn't there."""
        place = self._make(f"{self.path}/{below}".rstrip("/"))
        return sorted(status.getPath().getName() for status in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def has(self, below: str) -> bool:
        return self._fs.exists(self._make(f"{self.path}/{below}"))

    def remove(self, below: str) -> None:
        self._fs.delete(self._make(f"{self.path}/{below}"), True)
