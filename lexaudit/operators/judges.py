"""Judges: what turns a chunk into an answer. A rule judge in SQL, canned answers, and any batch function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import DEFAULT_CONFIDENCE
from ..sources.tables import shared_path, written


def rule_findings(found: DataFrame) -> DataFrame:
    """Findings without a model: an issue for every pattern that an analysed chunk shows, cited by its first indicator.

    ``found`` are the indicators of the chunks to analyse: filter chunks before the scan, so that no join is needed here. Chunks
    that were numbered by doc_id keep that partitioning, and the grouping adds no shuffle.
    """
    first = found.groupBy("doc_id", "chunk_index", "position", "pattern_ord").agg(F.min_by(F.struct("pattern", "description", "indicator", "related_refs"), "indicator_ord").alias("v"))
    return first.select(
        "doc_id", "chunk_index", F.lit("issue").alias("kind"), F.col("pattern_ord").alias("ord"),
        F.coalesce(F.col("v")["description"], F.col("v")["pattern"]).alias("description"),
        F.coalesce(F.get(F.col("v")["related_refs"], 0), F.lit("Unknown Regulation")).alias("regulation"),
        F.lit(DEFAULT_CONFIDENCE).alias("confidence"), F.concat(F.lit('"'), F.col("v")["indicator"], F.lit('"')).alias("citation"), F.lit("").alias("explanation"),
        F.col("position").alias("section"), F.lit(True).alias("should_analyze"),
    )


#: The request of a second stage; ``{response}`` is the first answer.
SECOND_TEMPLATE = """Put the findings of this audit into fields.

{response}

Under COMPLIANCE ISSUES: write ISSUE 1: and a title, then the lines Article:, Confidence: (High, Medium or Low), Explanation: and Citation: "...".
Under COMPLIANCE POINTS: do the same with POINT 1:. Without any, write No compliance issues found or No compliance points found.
"""


def restructure(judged: DataFrame, answer: Callable[[list[str]], list[str]], table: str | None = None, rows_per_call: int = 4, template: str = SECOND_TEMPLATE) -> DataFrame:
    """Findings of a second request that puts each answer into fields. ``table``: where the second answers are written; by default a table in the shared folder.

    Each answer is asked about once, and the answers are written before they are parsed, so no finding depends on a second evaluation. Where the second request fails, the first
    answer, which travels with it, is read line by line instead. Answers with an error are not asked about.
    """
    from . import answers

    first = judged.where("should_analyze and error is null").select("doc_id", "chunk_index", "position", "should_analyze", F.col("response").alias("first"))
    before, after = (F.lit(part) for part in template.split("{response}", 1))
    second = judge(first.withColumn("prompt", F.concat(before, F.col("first"), after)), answer, rows_per_call, ("first",))
    second = written(second, table or shared_path(judged.sparkSession, "second-answers"))
    in_fields = F.col("error").isNull()
    return answers.structured_findings(second.withColumns({"response": F.when(in_fields, F.col("response")).otherwise(F.col("first")), "in_fields": in_fields}).drop("first", "error"))


def judge(prompts: DataFrame, answer: Callable[[list[str]], list[str]], rows_per_call: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, chunk_index, position, should_analyze, the columns ``keep``, response, error, for the rows to analyse; the others get an empty response.

    ``answer`` maps a list of prompts to a list of answers on the executors. Skipped rows pass by it in the same read of
    ``prompts``, without their prompt. A failing call is repeated row by row, and the rows that still fail carry their error. Write the
    result to a table before it is used twice: answers are neither cheap nor repeatable.
    """
    analysed = F.coalesce("should_analyze", F.lit(False))
    rows = prompts.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "position", analysed.alias("should_analyze"), *keep, F.when(analysed, F.col("prompt")).alias("prompt"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("prompt").schema) + ", response string, error string"

    def one(prompt: str) -> tuple[str, str | None]:
        try:
            return answer([prompt])[0], None
        except Exception as e:  # the row carries the error; the job goes on
            return "", f"{type(e).__name__}: {e}"

    def ask(texts: list[str]) -> list[tuple[str, str | None]]:
        try:
            results = [(r, None) for r in answer(texts)]
            if len(results) != len(texts):
                raise ValueError(f"{len(results)} answers to {len(texts)} prompts")
        except Exception:
            results = [one(t) for t in texts]
        return results

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            analysed, prompts = batch.column("should_analyze").to_pylist(), batch.column("prompt").to_pylist()
            asked = [i for i, yes in enumerate(analysed) if yes]
            results: list[tuple[str, str | None]] = [("", None)] * len(batch)
            for at in range(0, len(asked), rows_per_call):
                part = asked[at : at + rows_per_call]
                for i, result in zip(part, ask([prompts[i] for i in part])):
                    results[i] = result
            columns = [*batch.columns[:-1], pa.array([r for r, _ in results], pa.string()), pa.array([e for _, e in results], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "response", "error"])

    return rows.mapInArrow(run, schema)
