"""Folders that the driver and all executors share, through Hadoop's file systems."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. One of our own is made only where none is set and all work is done in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go when the query ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def write(df: DataFrame, path: str, *partitions: str) -> None:
    """df as a new Parquet table. Hashes are half of a state; zstd halves their hexadecimal digits, the usual codec leaves them as they are."""
    with brief_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)


class Files:
    """Small files and listings under a root, on whatever file system that is."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._fs = self.path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self.path(name))) if self._fs.exists(self.path(name)) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def read(self, name: str) -> Any:
        stream = self._fs.open(self.path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, value: Any) -> bool:
        """Writes value as a new file that is seen whole or not at all; False if the name is taken."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self._fs.create(self.path(draft), False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        done = not self.exists(name) and self._fs.rename(self.path(draft), self.path(name))
        if not done:
            self.delete(draft)
        return done

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)
