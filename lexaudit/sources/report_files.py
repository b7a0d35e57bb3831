"""One text file for each row, under a name of its own: a data source to write with, which commits all files or none.

Tasks write into a staging folder beside the files, each attempt into a folder of its own. The commit moves the files of the attempts that Spark accepted, so attempts that
failed or ran twice leave nothing; an abort deletes the staging folder. The folder must be a path that the driver and all executors mount,
since Spark's Python writers have no access to other stores. A file of the same name is replaced, other files stay.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..functions import text as T


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class ReportWriter(DataSourceWriter):
    def __init__(self, folder: str):
        """On the driver. Tasks can't make the staging folder anew, so one that outlives an abort fails."""
        self.folder = folder
        self.staging = f"{folder}/_staging-{uuid.uuid4().hex}"
        os.makedirs(self.staging)

    def write(self, iterator: Iterator[Row]) -> Staged:
        context = TaskContext.get()
        own = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        os.mkdir(own)
        names = []
        for row in iterator:
            if not row.name or "/" in row.name or row.name.startswith((".", "_staging")):
                raise ValueError(f"not a name of a file: {row.name!r}")
            with open(f"{own}/{row.name}", "x", encoding="utf-8", errors="surrogatepass", newline="") as f:
                f.write(row.text or "")
            names.append(row.name)
        return Staged(own, names)

    def commit(self, messages: list[Staged | None]) -> None:
        staged = [(m.folder, name) for m in messages if m for name in m.names]
        names = [name for _, name in staged]
        if len(set(names)) < len(names):
            self._clear()
            raise ValueError(f"two rows have the name {next(n for n in names if names.count(n) > 1)}")
        for folder, name in staged:
            os.replace(f"{folder}/{name}", f"{self.folder}/{name}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Delete the staging folder; tasks that still run may put a file into it meanwhile."""
        for _ in range(100):
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.exists(self.staging):
                return
            time.sleep(0.05)


class ReportFiles(DataSource):
    """``df.write.format("report_files").mode("append").save(folder)`` for rows of (name, text)."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        folder = self.options.get("path", "").removeprefix("file://")
        if not folder.startswith("/"):
            raise ValueError("report_files needs the absolute path of a folder that the driver and all executors mount")
        if schema.names != ["name", "text"]:
            raise ValueError("report_files writes rows of (name, text)")
        return ReportWriter(folder)


def file_names(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, name: the document's own name without its ending, and ``_report.txt``; names that documents share get a hash of their ids."""
    bare = F.regexp_replace(F.regexp_replace(T.basename(F.coalesce(path, F.lit(""))), r"\.[^.]*$", ""), r"[^\p{L}\p{N}._-]|^[._]", "-")
    rows = docs.select("doc_id", bare.alias("bare"))
    shared = F.count("*").over(Window.partitionBy("bare")) > 1
    return rows.select("doc_id", F.concat("bare", F.when(shared | (F.col("bare") == ""), F.concat(F.lit("-"), F.left(F.md5(F.col("doc_id").cast("string")), F.lit(16)))).otherwise(""), F.lit("_report.txt")).alias("name"))


def write_files(reports: DataFrame, folder: str) -> None:
    """Write rows of (name, text) as files of ``folder``."""
    reports.sparkSession.dataSource.register(ReportFiles)
    reports.select("name", "text").write.format("report_files").mode("append").save(folder)
