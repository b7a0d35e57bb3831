"""Findings: merging of duplicates, counts, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import NO_QUOTE

ORDER = ("chunk_index", "ord")


def _first(value: Column, when: Column | None = None) -> Column:
    """The value of the first finding (of those that meet ``when``)."""
    order = F.struct(*ORDER)
    return F.min_by(value, order if when is None else F.when(when, order))


def ordered_union(values: Column) -> Column:
    """The distinct values of a grouped column in the order of first appearance."""
    seen = F.sort_array(F.collect_set(F.struct(*ORDER, values.alias("value"))))
    return F.array_distinct(F.transform(seen, lambda s: s["value"]))


def with_defaults(findings: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Findings with section, text and should_analyze filled from their chunk where they have none (``Unknown``, empty, true without a chunk)."""
    own = chunk_rows.select("doc_id", "chunk_index", F.col("position").alias("_position"), F.col("text").alias("_text"), F.col("should_analyze").alias("_analyzed"))
    rows = findings if "text" in findings.columns else findings.withColumn("text", F.lit(None).cast("string"))
    filled = rows.join(own, ["doc_id", "chunk_index"], "left").withColumns({
        "section": F.coalesce("section", "_position", F.lit("Unknown")),
        "text": F.coalesce("text", "_text", F.lit("")),
        "should_analyze": F.coalesce("should_analyze", "_analyzed", F.lit(True)),
    })
    return filled.drop("_position", "_text", "_analyzed")


def first_issues(findings: DataFrame, k: int = 3) -> DataFrame:
    """The first k findings of each chunk and kind."""
    order = Window.partitionBy("doc_id", "chunk_index", "kind").orderBy("ord")
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def with_key(findings: DataFrame, compat: bool = True) -> DataFrame:
    """Findings that have a description, with their key."""
    return findings.where(F.coalesce("description", F.lit("")) != "").withColumn("key", T.dedup_key(F.col("regulation"), F.col("description"), compat))


def deduplicate(findings: DataFrame, compat: bool = True) -> DataFrame:
    """One row per doc_id, kind and key.

    The first finding gives description, regulation, citation and explanation; the highest confidence and all sections (in order) are
    kept. If the first comes from a skipped chunk and a later one doesn't, the first such gives the explanation, and the
    citation unless it is the placeholder. One grouped aggregation with partial results before the shuffle.
    """
    analyzed = F.coalesce("should_analyze", F.lit(True))
    rank = T.confidence_rank(F.col("confidence"))
    first_analyzed = lambda c: _first(F.struct(c.alias("v")), analyzed)
    grouped = with_key(findings, compat).groupBy("doc_id", "kind", "key").agg(
        _first(F.col("description")).alias("description"),
        _first(F.col("regulation")).alias("regulation"),
        F.max_by("confidence", F.struct(rank, *(-F.col(c) for c in ORDER))).alias("confidence"),
        _first(F.col("citation")).alias("citation"),
        _first(F.col("explanation")).alias("explanation"),
        _first(analyzed).alias("first_analyzed"),
        first_analyzed(F.col("citation")).alias("later_citation"),
        first_analyzed(F.col("explanation")).alias("later_explanation"),
        ordered_union(F.col("section")).alias("sections"),
        F.bool_or(analyzed).alias("should_analyze"),
        F.min(F.struct(*ORDER)).alias("first"),
        F.count("*").alias("n_merged"),
    )
    adopts = ~F.col("first_analyzed") & F.col("should_analyze")
    citation = F.when(adopts & F.col("later_citation")["v"].isNotNull() & (F.col("later_citation")["v"] != NO_QUOTE), F.col("later_citation")["v"]).otherwise(F.col("citation"))
    return grouped.select(
        "doc_id", "kind", "key", "description", "regulation", "confidence", citation.alias("citation"),
        F.when(adopts, F.col("later_explanation")["v"]).otherwise(F.col("explanation")).alias("explanation"),
        "sections", "should_analyze", F.col("first")["chunk_index"].alias("first_chunk"), F.col("first")["ord"].alias("first_ord"), "n_merged",
    )


def in_order(deduped: DataFrame) -> DataFrame:
    """position: the place of a finding in its document, by confidence, regulation and first appearance."""
    rank = F.when(T.confidence_rank(F.col("confidence")) == 0, 3).otherwise(3 - T.confidence_rank(F.col("confidence")))
    order = Window.partitionBy("doc_id", "kind").orderBy(rank, "regulation", "first_chunk", "first_ord", "key")
    return deduped.withColumn("position", F.row_number().over(order))


def counts(findings: DataFrame) -> DataFrame:
    """Per document: findings of each kind before and after merging."""
    keyed = with_key(findings).select("doc_id", "kind", "key")
    kept = keyed.groupBy("doc_id").agg(*(F.count_distinct(F.when(F.col("kind") == k, F.col("key"))).alias(f"final_{k}s") for k in ("issue", "point")))
    raw = findings.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(f"original_{k}s") for k in ("issue", "point")))
    return raw.join(kept, "doc_id", "left").na.fill(0)


def confidence_breakdown(deduped: DataFrame) -> DataFrame:
    level = lambda name: F.count_if(F.upper("confidence") == name)
    analyzed = F.count_if("should_analyze")
    return deduped.groupBy("doc_id", "kind").agg(
        F.count("*").alias("total"), level("HIGH").alias("high"), level("MEDIUM").alias("medium"), level("LOW").alias("low"),
        analyzed.alias("analyzed"), (F.count("*") - analyzed).alias("skipped"),
    )


def rollups(deduped: DataFrame) -> DataFrame:
    """doc_id, of, kind, confidence, regulation, n_findings, n_analyzed: counts by document, by kind, by kind and confidence and by kind and regulation, from one shuffle.

    ``of`` (document, kind, confidence, regulation) names the grouping; columns that it leaves out are null. Confidences are in upper case.
    """
    rows = deduped.select("doc_id", "kind", F.upper("confidence").alias("confidence"), "regulation", "should_analyze")
    sets = (["doc_id"], ["doc_id", "kind"], ["doc_id", "kind", "confidence"], ["doc_id", "kind", "regulation"])
    of = F.when(F.grouping("confidence") == 0, "confidence").when(F.grouping("regulation") == 0, "regulation").when(F.grouping("kind") == 0, "kind").otherwise("document")
    return rows.groupingSets(sets, "doc_id", "kind", "confidence", "regulation").agg(of.alias("of"), F.count("*").alias("n_findings"), F.count_if("should_analyze").alias("n_analyzed"))


def by_regulation(deduped: DataFrame) -> DataFrame:
    """Per document, kind and regulation: the number of findings and the place of the first."""
    return in_order(deduped).groupBy("doc_id", "kind", "regulation").agg(F.count("*").alias("n_findings"), F.min("position").alias("first_position"))


def by_description(deduped: DataFrame) -> DataFrame:
    """Within a regulation, findings of one description: their sections in order, and the confidence and state of the first."""
    placed = in_order(deduped)
    inner = F.sort_array(F.collect_list(F.struct("position", "sections")))
    return placed.groupBy("doc_id", "kind", "regulation", "description").agg(
        F.array_distinct(F.flatten(F.transform(inner, lambda s: s["sections"]))).alias("sections"),
        F.min_by("confidence", "position").alias("confidence"),
        F.min_by("should_analyze", "position").alias("should_analyze"),
        F.min("position").alias("first_position"),
    )
