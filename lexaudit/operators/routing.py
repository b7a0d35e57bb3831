"""Term scores and the routing of chunks to analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.values import LONG_CHUNK, MIN_SCORE, SHORT_CHUNK
from .needles import find_needles


def term_score(text: Column, terms) -> Column:
    """How many entries of the list the lower-cased text contains as substrings; entries are compared as they are written."""
    terms = list(terms)
    listed = F.array(*map(F.lit, terms)).cast("array<string>")
    return let(F.lower(text), lambda lowered: F.size(F.filter(listed, lambda t: F.contains(lowered, t))))


def should_analyze(text: Column, score: Column) -> Column:
    """Short chunks never; others from a score of 3, or if they are long."""
    n = F.length(F.lower(text))
    return F.when(n < SHORT_CHUNK, False).otherwise((score >= MIN_SCORE) | (n > LONG_CHUNK))


def route(chunk_rows: DataFrame, data_terms, regulatory_terms) -> DataFrame:
    """``chunk_rows`` with data_score, regulatory_score, total_score and should_analyze: one flag, no second scan."""
    scored = chunk_rows.withColumns({"data_score": term_score(F.col("text"), data_terms), "regulatory_score": term_score(F.col("text"), regulatory_terms)})
    scored = scored.withColumn("total_score", F.col("data_score") + F.col("regulatory_score"))
    return scored.withColumn("should_analyze", should_analyze(F.col("text"), F.col("total_score")))


def join_terms(chunk_rows: DataFrame, terms: DataFrame) -> DataFrame:
    """chunk × (term_type, term) for every term that the lower-cased text contains."""
    return find_needles(chunk_rows.withColumn("lowered", F.lower("text")), "lowered", terms, "term").drop("lowered", "at")


def batches(chunk_rows: DataFrame, batch_size: int) -> DataFrame:
    """batch_no (from 1) and the number of batches of the document."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return chunk_rows.withColumns({
        "batch_no": (F.floor(F.col("chunk_index") / batch_size) + 1).cast("int"),
        "n_batches": F.ceil(total / batch_size).cast("int"),
    })
