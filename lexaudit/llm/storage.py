"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a table is written: whole texts and shingle sets are large.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a local master gets a temporary folder (tests); a cluster, whose machines share none, is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _FALLBACK.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lexaudit-"))


class Workspace:
    """Written tables of one operator run. They cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path, rows = f"{self.root}/{tag}", self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, min(int(rows), BATCH_ROWS))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_BATCH, rows)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Delete tables that no later plan reads. What the result still reads stays until the application's folder is cleared."""
        jvm = self.spark.sparkContext._jvm
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tag}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
