"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Path of spark.checkpoint.dir; in local mode an own temporary folder where it is unset."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="gridloom-")
    return _own


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows starts from there."""
    path = f"{shared_folder(df.sparkSession)}/gridloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession, hours: float) -> int:
    """Delete this library's tables in the shared folder that nothing has written to for so long; how many.

    Results are read from such tables, so only those of finished work may go.
    """
    folder = Folder(spark, shared_folder(spark))
    old = [n for n, written in folder.times().items() if n.startswith("gridloom-") and written < time.time() - hours * 3600]
    for name in old:
        folder.delete(name)
    return len(old)


class Folder:
    """Files below a path of any file system that Spark knows, for the driver's own small files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        fs, at = self._fs(), self._at(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def times(self) -> dict[str, float]:
        """When each entry was last written to, in seconds."""
        fs, at = self._fs(), self._at("")
        return {x.getPath().getName(): x.getModificationTime() / 1000 for x in fs.listStatus(at)} if fs.exists(at) else {}

    def delete(self, name: str) -> None:
        self._fs().delete(self._at(name), True)

    def save(self, name: str, text: str) -> None:
        """Replace a small file as a whole: it is written aside and renamed."""
        fs, aside = self._fs(), self._at(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(self._at(name), False)
        fs.rename(aside, self._at(name))

    def load(self, name: str) -> str | None:
        fs = self._fs()
        if not fs.exists(self._at(name)):
            return None
        found = fs.open(self._at(name))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        found.close()
        return text
