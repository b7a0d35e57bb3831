"""Answers of a judge that are kept by the hash of their request, so that no request is answered twice.

A store is a folder of batches. A run asks only requests without a kept answer, each once however many rows make it, writes the answers beside the
batches and moves them among them in one rename. The name of a batch is a hash of its requests, so a batch that is committed a second time is dropped. Answers with an
error are not kept: they are asked again by the next run. Two runs at the same time may both ask a request; readers then take one answer, the same for all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Folder, written
from . import judges

_KEPT = "key string, response string"


class AnswerStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._folder = Folder(spark, path)

    def answers(self) -> DataFrame:
        """key, response: one row for each request with an answer."""
        batches = [n for n in Folder(self.spark, f"{self.path}/batches").names() if n.startswith("batch-")]
        if not batches:
            return self.spark.createDataFrame([], _KEPT)
        rows = self.spark.read.schema(_KEPT).parquet(*(f"{self.path}/batches/{b}" for b in batches))
        return rows.groupBy("key").agg(F.min("response").alias("response"))

    def _commit(self, staged: str) -> None:
        """Move the answers of a staged run among the batches; a batch of the same requests and answers may be there already."""
        kept = self.spark.read.parquet(f"{self.path}/{staged}").where("error is null").select("key", "response")
        n, digest = kept.agg(F.count("*"), F.bit_xor(F.xxhash64("key", "response"))).first()
        if n:
            name = f"new-{uuid.uuid4().hex}"
            written(kept, f"{self.path}/{name}")
            self._folder.rename(name, f"batches/batch-{n}-{digest & (1 << 64) - 1:016x}")
            self._folder.delete(name)  # what a batch that was there already leaves

    def ask(self, prompts: DataFrame, answer: Callable[[list[str]], list[str]], rows_per_call: int = 4, slices: int = 1) -> DataFrame:
        """The columns of ``judges.judge``, and ``kept``: whether the answer was there before this run.

        ``slices``: the new requests are asked and committed in so many parts, by their hash; a run that ends early keeps the parts it committed.
        """
        keyed = prompts.withColumn("key", F.when(F.col("should_analyze"), F.sha2(F.coalesce("prompt", F.lit("")), 256)))
        run = f"run-{uuid.uuid4().hex}"
        rows = written(keyed.select("doc_id", "chunk_index", "position", "should_analyze", "key"), f"{self.path}/{run}-rows")
        before = written(self.answers(), f"{self.path}/{run}-before")
        once = keyed.where("key is not null").groupBy("key").agg(F.any_value("prompt").alias("prompt"))
        asked = None
        for part in range(slices):
            new = once.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == part).join(before, "key", "left_anti")
            requests = new.select(F.col("key").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("").alias("position"), F.lit(True).alias("should_analyze"), "prompt")
            done = written(judges.judge(requests, answer, rows_per_call).select(F.col("doc_id").alias("key"), "response", "error"), f"{self.path}/{run}-asked-{part}")
            self._commit(f"{run}-asked-{part}")
            asked = done if asked is None else asked.union(done)
        found = before.select("key", "response", F.lit(None).cast("string").alias("error"), F.lit(True).alias("kept")).union(asked.withColumn("kept", F.lit(False)))
        return rows.join(found, "key", "left").select(
            "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "position", F.coalesce("should_analyze", F.lit(False)).alias("should_analyze"), F.coalesce("response", F.lit("")).alias("response"), "error", F.coalesce("kept", F.lit(False)).alias("kept")
        )

    def clean(self) -> None:
        """Delete the tables of earlier runs, which results that are still read may need. Answers stay."""
        for name in self._folder.names():
            if name.startswith(("run-", "new-")):
                self._folder.delete(name)
