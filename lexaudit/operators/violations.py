"""Indicator scans: chunk × violation patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.values import CONTEXT_CHARS, TOP_VIOLATIONS
from .needles import find_needles


def indicator_rows(patterns: DataFrame) -> DataFrame:
    """One row per indicator of each pattern that has a name: pattern_ord, indicator_ord, pattern, description, indicator, related_refs."""
    rows = patterns.where("pattern is not null and pattern <> ''").select("pattern_ord", "pattern", "description", "related_refs", F.posexplode("indicators").alias("indicator_ord", "indicator"))
    return rows.select("pattern_ord", "indicator_ord", "pattern", "description", "indicator", "related_refs")


def scan_indicators(chunk_rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """Every indicator that a chunk holds in any case, with the text around its first place."""
    found = find_needles(chunk_rows.withColumn("lowered", F.lower("text")), "lowered", indicators.withColumn("wanted", F.lower("indicator")), "wanted")
    start = F.greatest(F.col("at") - CONTEXT_CHARS, F.lit(1))
    context = F.substring(F.col("text"), start, F.col("at") + F.length("indicator") + CONTEXT_CHARS - start)
    return found.withColumn("context", context).drop("lowered", "wanted", "at")


def top_violations(found: DataFrame, k: int = TOP_VIOLATIONS) -> DataFrame:
    order = Window.partitionBy("doc_id", "chunk_index").orderBy("pattern_ord", "indicator_ord")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def detected_patterns(rows: DataFrame, column: str = "detected") -> DataFrame:
    """Violations of an array of texts like ``pattern: 'indicator'``: all columns but the array, pattern, indicator, context, related_refs. Texts without a colon are left out."""
    each = rows.select(*[c for c in rows.columns if c != column], F.explode(column).alias("detected")).where(F.contains("detected", F.lit(":")))
    parts = F.split("detected", ":", 2)
    indicator = F.btrim(strip(parts[1]), F.lit("'"))
    named = each.select(*[c for c in rows.columns if c != column], strip(parts[0]).alias("pattern"), indicator.alias("indicator"))
    return named.withColumns({"context": F.concat(F.lit("..."), F.col("indicator"), F.lit("...")), "related_refs": F.array().cast("array<string>")})
