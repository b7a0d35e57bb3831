"""Answers of a judge in JSON, with topic tags: parsed by a schema where they are valid, repaired where they are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import CONFIDENCES, DEFAULT_CONFIDENCE, JSON_FIELDS, JSON_ISSUES, JSON_TAGS, UNKNOWN_REGULATION

_ITEM = f"struct<{', '.join(f'{f}: string' for f in JSON_FIELDS)}>"


def _array_of(pieces: Column) -> Column:
    """The valid objects among texts of objects."""
    return F.transform(F.filter(pieces, lambda p: F.try_parse_json(p).isNotNull()), lambda p: F.from_json(p, _ITEM))


def normal_tag(tag: Column) -> Column:
    """A tag in lower case, with one underscore for each run of other characters than letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(tag), "[^a-z0-9]+", "_"), "^_|_$", "")


def _confidence(text: Column) -> Column:
    named = F.initcap(T.strip(F.coalesce(text, F.lit(""))))
    return F.when(named.isin(*CONFIDENCES), named).otherwise(DEFAULT_CONFIDENCE)


def _filled(text: Column, default: str = "") -> Column:
    bare = T.strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", default).otherwise(bare)


def parse_json_answers(responses: DataFrame) -> DataFrame:
    """The columns of ``answers.parse_answers``, and ``tags`` (sorted, in one spelling) and ``repaired``, one row for each issue.

    The object reaches from the first opening to the last closing brace, so fences and words around it don't matter. A valid object is read by its schema. Of a broken
    one, the inner objects that are valid by themselves are kept (those with braces inside their texts aren't found), and the quoted words after the name of the tags. An item
    without a description is left out; other missing fields get defaults.
    """
    answer = F.coalesce("response", F.lit(""))
    body = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    whole = F.from_json(body, f"{JSON_ISSUES} array<{_ITEM}>, {JSON_TAGS} array<string>")
    listed = F.regexp_extract(answer, rf'"{JSON_TAGS}"\s*:\s*\[([^\]]*)', 1)
    rows = responses.withColumns({"valid": F.try_parse_json(body).isNotNull() & (body != ""), "whole": whole})
    rows = rows.withColumns({
        "items": F.when(F.col("valid"), F.col(f"whole.{JSON_ISSUES}")).otherwise(_array_of(F.regexp_extract_all(answer, F.lit(r"\{[^{}]*\}"), F.lit(0)))),
        "named": F.when(F.col("valid"), F.col(f"whole.{JSON_TAGS}")).otherwise(F.regexp_extract_all(listed, F.lit('"([^"]*)"'), F.lit(1))),
    })
    tags = F.sort_array(F.array_distinct(F.filter(F.transform(F.coalesce("named", F.array().cast("array<string>")), normal_tag), lambda t: t != "")))
    each = rows.select("doc_id", "chunk_index", "position", "should_analyze", tags.alias("tags"), (~F.col("valid")).alias("repaired"), F.posexplode(T.let(F.col("items"), lambda x: x)).alias("ord", "v"))  # of a bare column Spark infers a filter, and parses below the shuffle that spreads the answers
    issue, regulation, confidence, explanation, citation = (F.col("v")[f] for f in JSON_FIELDS)
    return each.where(T.strip(F.coalesce(issue, F.lit(""))) != "").select(
        "doc_id", "chunk_index", F.lit("issue").alias("kind"), "ord", _filled(issue).alias("description"), _filled(regulation, UNKNOWN_REGULATION).alias("regulation"), _confidence(confidence).alias("confidence"),
        _filled(citation).alias("citation"), _filled(explanation).alias("explanation"), F.col("position").alias("section"), "should_analyze", "tags", "repaired",
    )
