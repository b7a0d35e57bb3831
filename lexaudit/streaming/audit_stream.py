"""Documents as a stream: what concerns one document runs in the stream, findings are merged per micro-batch.

Sections, chunk parts, scores and routes need no state. A chunk's number and the merging of findings belong to one document, and a
document arrives whole, so both run inside ``foreachBatch`` without state across batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import documents, findings, routing
from ..plans.audit import Framework, rule_audit


def read_document_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """doc_id, path, n_bytes, text of the text files that arrive in a folder."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(path)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("n_bytes"), F.col("value").alias("text"))


def routed_parts(docs: DataFrame, rules: Framework) -> DataFrame:
    """Chunk parts (numbered within their section) with scores and routes, of a stream or a table."""
    size, overlap = T.chunk_parameters(F.octet_length("text"), 500, 100)
    rows = documents.sections(docs.withColumns({"chunk_size": size, "chunk_overlap": overlap}))
    return routing.route(documents.chunk_parts(rows, F.col("chunk_size"), F.col("chunk_overlap")), rules.data_terms, rules.regulatory_terms)


def audit_stream(docs: DataFrame, rules: Framework, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the merged findings of every micro-batch to ``out``, one folder per batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _, raw = rule_audit(batch, rules)
        findings.deduplicate(raw).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
