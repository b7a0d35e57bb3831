"""Prompts as columns: formatted regulations, violations and the whole request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import PATTERNS_LINE, REGULATION_LABELS, TOP_REGULATIONS, TOP_VIOLATIONS, VIOLATION_LINES, VIOLATIONS_TITLE

#: Parts in braces are replaced by columns. A framework may bring its own.
DEFAULT_TEMPLATE = """You audit documents for compliance. Find the issues and the points of compliance of this section.

SECTION: {section}
TEXT:
{text}

RELEVANT REGULATIONS:
{regulations}

CONTENT INDICATORS:
{indicators}

{violations}
{guidance}
Answer with numbered items under the headings COMPLIANCE ISSUES: and COMPLIANCE POINTS:. Each item names its regulation in
parentheses and ends with a quotation of the text. Without any, write NO COMPLIANCE ISSUES DETECTED. or NO COMPLIANCE POINTS DETECTED.
"""
GUIDANCE = {"high": "This section is of HIGH RISK: report every violation, subtle ones too.", "medium": "This section is of MEDIUM RISK: report the significant issues.", "low": "This section is of LOW RISK: report clear violations only."}


def format_regulations(hits: Column, label: str = "REGULATION", context: str = "", n_patterns: int = 0) -> Column:
    """Text of an array of (id, title, text, related_concepts)."""
    first = [F.lit(label + REGULATION_LABELS[0] + context)] if context else []
    first += [F.lit(PATTERNS_LINE % n_patterns)] if n_patterns else []

    def one(hit: Column, i: Column) -> Column:
        title = F.when(F.coalesce(hit["title"], F.lit("")) != "", F.concat(F.lit(" - "), hit["title"])).otherwise("")
        concepts = F.when(F.size(hit["related_concepts"]) > 0, F.concat(F.lit(REGULATION_LABELS[1]), F.array_join(hit["related_concepts"], ", "))).otherwise("")
        return F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(": "), hit["id"], title, concepts, F.lit("\n"), hit["text"])

    texts = F.transform(F.slice(hits, 1, TOP_REGULATIONS), one)
    return F.array_join(F.concat(F.array(*first), texts) if first else texts, "\n\n")


def format_violations(violations: Column) -> Column:
    """Text of the first of an array of (pattern, description, indicator, context, related_refs)."""

    head, described, shown, related = VIOLATION_LINES

    def one(v: Column, i: Column) -> Column:
        description = F.when(F.coalesce(v["description"], F.lit("")) != "", F.format_string(described, v["description"])).otherwise("")
        refs = F.when(F.size(v["related_refs"]) > 0, F.format_string(related, F.array_join(v["related_refs"], ", "))).otherwise("")
        return F.concat(F.format_string(head, i + 1, v["pattern"]), description, F.format_string(shown, v["indicator"], v["context"]), refs, F.lit("\n"))

    text = F.array_join(F.transform(F.slice(violations, 1, TOP_VIOLATIONS), one), "")
    return F.when(F.size(violations) > 0, F.concat(F.lit(VIOLATIONS_TITLE), text)).otherwise("")


def build_prompt(section: Column, text: Column, regulations: Column, indicators: Column, violations: Column, risk_level: str = "unknown", template: str = DEFAULT_TEMPLATE) -> Column:
    import re

    values = {"section": section, "text": text, "regulations": regulations, "indicators": T.indicator_bullets(indicators), "violations": violations, "guidance": F.lit(GUIDANCE.get(risk_level, ""))}
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def with_prompts(chunk_rows: DataFrame, hits: DataFrame, violations: DataFrame, label: str = "REGULATION", context: str = "", n_patterns: int = 0, regulations: Callable[[Column], Column] | None = None, indicators: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """``chunk_rows`` with a prompt column. Hits carry rank, id, title, text, related_concepts; both sides are grouped per chunk first.

    ``regulations`` (array of hits to text) and ``indicators`` (text to map) replace the default formats.
    """
    keys = ["doc_id", "chunk_index"]
    ordered = lambda cols, by: F.sort_array(F.collect_list(F.struct(*by, F.struct(*cols).alias("v"))))
    regs = hits.groupBy(*keys).agg(F.transform(ordered(["id", "title", "text", "related_concepts"], ["rank"]), lambda s: s["v"]).alias("hits"))
    found = violations.groupBy(*keys).agg(F.transform(ordered(["pattern", "description", "indicator", "context", "related_refs"], ["pattern_ord", "indicator_ord"]), lambda s: s["v"]).alias("violations"))
    rows = chunk_rows.join(regs, keys, "left").join(found, keys, "left")
    kind = "array<struct<pattern:string,description:string,indicator:string,context:string,related_refs:array<string>>>"
    listed = F.coalesce("hits", F.array().cast("array<struct<id:string,title:string,text:string,related_concepts:array<string>>>"))
    shown = F.coalesce(regulations(listed) if regulations else format_regulations(listed, label, context, n_patterns), F.lit(""))
    prompt = build_prompt(F.col("position"), F.col("text"), shown, (indicators or T.content_indicators)(F.col("text")), format_violations(F.coalesce("violations", F.array().cast(kind))), **options)
    return rows.withColumn("prompt", prompt).drop("hits", "violations")
