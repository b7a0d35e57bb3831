"""Findings of different sections that may contradict each other: the same topic, opposite statements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import CONFIDENCES, CONTRADICTION, CONTRADICTION_FIELDS, DEFAULT_CONFIDENCE, DENIALS
from ..sources.tables import shared_path, written

#: Chunks of a document that a task reads together where one topic runs through all of it.
BLOCK_CHUNKS = 256
_SIDES = ("affirms", "denies")
TEMPLATE = """Two findings of one document speak of {tags}.

First ({earlier_section}): {earlier_description}
Second ({later_section}): {later_description}

If they contradict each other, answer with a JSON array of one object with the fields issue, section, confidence (High, Medium or Low), explanation and finding_type ("contradiction"). If they don't, answer with [].
"""


def stance(text: Column) -> Column:
    """denies, if the statement holds a word of denial; else affirms."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?i)\b(?:" + "|".join(DENIALS) + r")\b"), _SIDES[1]).otherwise(_SIDES[0])


def candidate_pairs(findings: DataFrame) -> DataFrame:
    """doc_id, earlier_chunk, earlier_ord, later_chunk, later_ord, the sections and descriptions of both, and ``tags``: the topics that pair them.

    ``findings`` has doc_id, chunk_index, ord, section, description and ``tags``. On each topic a finding is paired with the last finding of the opposite stance in an earlier
    chunk, unless both are of one section, so there is at most one pair for each finding and topic, not one for every two findings of a topic. The search is a scan in two phases: within blocks
    of ``BLOCK_CHUNKS`` chunks, and over one row for each block, which hands on the last finding of each stance; no task holds all findings of a topic that runs through a large document.
    """
    own = F.struct("chunk_index", "ord", "section", "description")
    posted = findings.where("doc_id is not null and chunk_index is not null").select("doc_id", "chunk_index", "ord", own.alias("own"), stance(F.col("description")).alias("stance"), F.explode(F.array_distinct("tags")).alias("tag"))
    # written once: the findings within blocks and the rows of blocks are both made of them, and would parse the answers again
    posted = written(posted.withColumn("block", F.floor(F.col("chunk_index") / BLOCK_CHUNKS).cast("long")), shared_path(findings.sparkSession, "posted-findings"))
    earlier = Window.partitionBy("doc_id", "tag", "block").orderBy("chunk_index").rangeBetween(Window.unboundedPreceding, -1)
    side = lambda s: F.when(F.col("stance") == s, F.col("own"))
    near = posted.withColumns({s: F.max(side(s)).over(earlier) for s in _SIDES})
    blocks = posted.groupBy("doc_id", "tag", "block").agg(*(F.max(side(s)).alias(s) for s in _SIDES))
    before = Window.partitionBy("doc_id", "tag").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = blocks.select("doc_id", "tag", "block", *(F.max(s).over(before).alias(f"before_{s}") for s in _SIDES))
    met = near.join(handed, ["doc_id", "tag", "block"])
    opposite = F.when(F.col("stance") == _SIDES[0], F.coalesce(_SIDES[1], f"before_{_SIDES[1]}")).otherwise(F.coalesce(_SIDES[0], f"before_{_SIDES[0]}"))
    pairs = met.withColumn("other", opposite).where("other is not null and not (other.section <=> own.section)")
    grouped = pairs.groupBy("doc_id", "other", "own").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    columns = [F.col(f"{s}.{c}").alias(f"{name}_{as_name}") for s, name in (("other", "earlier"), ("own", "later")) for c, as_name in (("chunk_index", "chunk"), ("ord", "ord"), ("section", "section"), ("description", "description"))]
    return grouped.select("doc_id", *columns, "tags")


def requests(pairs: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The columns that ``judges.judge`` asks by: one request for each pair, under the chunk of its later finding."""
    values = {"tags": F.array_join("tags", ", ")}
    parts = re.split(r"\{(\w+)\}", template)  # texts and names of columns by turns, so that no mark is looked for in a column's text
    prompt = F.concat(*(F.coalesce(values.get(part, F.col(part)), F.lit("")) if i % 2 else F.lit(part) for i, part in enumerate(parts)))
    return pairs.select("doc_id", F.col("later_chunk").alias("chunk_index"), F.concat_ws(" / ", "earlier_section", "later_section").alias("position"), F.lit(True).alias("should_analyze"), prompt.alias("prompt"))


def parse_contradictions(judged: DataFrame) -> DataFrame:
    """doc_id, chunk_index, ord, description, section, confidence, explanation of the contradictions in answers that are JSON arrays; other answers give none."""
    body = F.regexp_extract(F.coalesce("response", F.lit("")), r"(?s)\[.*\]", 0)
    rows = judged.select("doc_id", "chunk_index", "position", F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, f"array<struct<{', '.join(f'{f}: string' for f in CONTRADICTION_FIELDS)}>>")).alias("found"))
    issue, section, confidence, explanation, kind = (F.col("v")[f] for f in CONTRADICTION_FIELDS)
    named = F.initcap(F.trim(confidence))
    return rows.select("doc_id", "chunk_index", "position", F.posexplode("found").alias("ord", "v")).where((F.coalesce(kind, F.lit(CONTRADICTION)) == CONTRADICTION) & (F.trim(issue) != "")).select(
        "doc_id", "chunk_index", "ord", F.trim(issue).alias("description"), F.coalesce(section, "position").alias("section"), F.when(named.isin(*CONFIDENCES), named).otherwise(DEFAULT_CONFIDENCE).alias("confidence"), F.coalesce(explanation, F.lit("")).alias("explanation")
    )
