"""Tables that are written once and read several times, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset a local master gets a temporary folder (tests); a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lexaudit-"))
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``: its rows are computed once, however often they are read."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self._conf), path

    def names(self) -> list[str]:
        fs, path = self._at("")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def rename(self, source: str, target: str) -> bool:
        """False if the target is there already, or the store refuses."""
        (fs, a), (_, b) = self._at(source), self._at(target)
        fs.mkdirs(b.getParent())
        return not fs.exists(b) and fs.rename(a, b)
