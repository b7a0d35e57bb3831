"""Reports: JSON per document and ordered text lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import scanned_bytes
from . import findings as G

# Lines of the text report.
RULE, THIN, SHORT_RULE = "=" * 80, "-" * 80, "-" * 40
TITLES = {"issue": ("ISSUES", "Issues", "CONCERNS", "Issue"), "point": ("COMPLIANCE POINTS", "Points", "STRENGTHS", "Point")}


#: Bytes of the inputs, as scanned, whose rows of lines a task sorts; and the most tasks.
TASK_BYTES, MAX_TASKS = 1_000_000, 10_000


def report_json(docs: DataFrame, deduped: DataFrame, framework: str, progressive: bool = True) -> DataFrame:
    """doc_id, report: one JSON text per document. A single section is a text, several are an array."""
    placed = G.in_order(deduped)

    def entries(kind: str) -> Column:
        one = F.struct(
            F.col("position"), F.col("description").alias(kind), F.col("regulation"), F.col("confidence"), F.col("explanation"), F.col("citation"),
            F.when(F.size("sections") == 1, F.get("sections", 0)).alias("section"), F.when(F.size("sections") != 1, F.col("sections")).alias("sections"), F.col("should_analyze"),
        )
        listed = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, one)))
        return F.transform(listed, lambda x: x.dropFields("position"))

    grouped = placed.groupBy("doc_id").agg(entries("issue").alias("findings"), entries("point").alias("compliance_points"))
    joined = docs.select("doc_id", *[c for c in ("path", "document_type") if c in docs.columns]).join(grouped, "doc_id", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    body = F.struct(
        (T.basename(F.col("path")) if "path" in docs.columns else F.col("doc_id").cast("string")).alias("document"),
        F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
        F.lit(framework).alias("regulation_framework"),
        F.coalesce("findings", F.array()).alias("findings"),
        F.coalesce("compliance_points", F.array()).alias("compliance_points"),
        F.lit("progressive" if progressive else "standard").alias("analysis_type"),
        T.summary_sentence(size("findings"), size("compliance_points"), framework).alias("summary"),
    )
    return joined.select("doc_id", F.to_json(body).alias("report"))


def _lines(rows: DataFrame, groups: list[tuple[list, list]]) -> DataFrame:
    """doc_id, at_0 to at_2, lines: the non-null lines of each row. A group is a place (columns or numbers) and lines; a row is read once for all groups."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    placed = [
        F.struct(*(column(k).cast("bigint").alias(f"at_{i}") for i, k in enumerate([*place, 0, 0][:3])), F.filter(F.array(*map(column, lines)), lambda x: x.isNotNull()).alias("lines"))
        for place, lines in groups
    ]
    return rows.select("doc_id", F.inline(F.array(*placed))).where(F.size("lines") > 0)


def _tasks(*inputs: DataFrame) -> int:
    """At least the cores, and one for each ``TASK_BYTES`` of the inputs; Spark's number of shuffle partitions if their size isn't known."""
    spark = inputs[0].sparkSession
    size = scanned_bytes(*inputs)
    return min(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), MAX_TASKS) if size is not None else int(spark.conf.get("spark.sql.shuffle.partitions"))


def report_lines(docs: DataFrame, chunk_results: DataFrame, raw: DataFrame, deduped: DataFrame, framework: str, date: str, progressive: bool | None = None) -> DataFrame:
    """doc_id, line_no, line: the text report of every document.

    Unless ``progressive`` says so, a document's analysis was progressive if any of its chunks was routed: if its should_analyze isn't null.

    ``docs`` has doc_id, document_type and the two lists of mentions; ``chunk_results`` doc_id, chunk_index, position, text,
    should_analyze; ``raw`` the findings as parsed, ``deduped`` as merged. Write expensive inputs to tables first: each is read
    a few times. The lines come from five row sources (documents, regulations, merged findings, chunks, findings). Rows are numbered by the
    sizes of their lists of lines, which become rows of their own after that; and the number of tasks grows with the inputs: shuffles of a size
    that is left to Spark are merged by their compressed bytes, and lines compress so well that a task then sorts ever more of them.
    """
    tasks = _tasks(docs, chunk_results, raw)
    docs, found, deduped = (rows.repartition(tasks, "doc_id") for rows in (docs, raw, deduped))
    # Fixed values, here and below: the literal lines of the report.
    say = F.format_string
    count = lambda c: F.col(c).cast("long")
    levels = ("total", "high", "medium", "low", "analyzed", "skipped")
    per_kind = G.confidence_breakdown(deduped).groupBy("doc_id").agg(*(F.sum(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}") for kind in TITLES for c in levels))
    wide = docs.join(G.counts(found), "doc_id", "left").join(per_kind, "doc_id", "left").na.fill(0)
    if progressive is None:
        wide = wide.join(chunk_results.groupBy("doc_id").agg(F.bool_or(F.col("should_analyze").isNotNull()).alias("progressive")), "doc_id", "left")
    else:
        wide = wide.withColumn("progressive", F.lit(progressive))
    mentions = lambda c: F.array_join(c, ", ")
    method = ["Analysis Method: Progressive (focused on relevant sections)", say("- From analyzed sections: %d", count("issue_analyzed")), say("- From skipped sections: %d", count("issue_skipped"))]
    head = [
        RULE, f"{framework.upper()} COMPLIANCE ANALYSIS REPORT", RULE, "",
        say("Document: %s", T.basename(F.col("path")) if "path" in docs.columns else F.col("doc_id").cast("string")), say("Document Type: %s", F.col("document_type")), f"Regulation: {framework}", f"Analysis Date: {date}", "",
        "POTENTIAL DATA CONTEXT:", say("Data mentions: %s", mentions("potential_data_mentions")), say("Compliance indicators: %s", mentions("compliance_indicators")), "",
        say("Total Issues Found: %d", count("issue_total")), *(F.when(F.col("progressive"), line) for line in method),
        "", "PROCESSING SUMMARY:",
        say("- Original issues: %d → Final: %d", count("original_issues"), count("final_issues")), say("- Original compliance points: %d → Final: %d", count("original_points"), count("final_points")),
    ]
    groups = [([0], head), ([30], ["DETAILED ANALYSIS BY SECTION:", RULE, ""])]
    for n, (kind, (title, noun, summary, _)) in enumerate(TITLES.items()):
        some = F.col(f"{kind}_total") > 0
        opening = [
            *([""] if kind == "issue" else []), f"CONFIDENCE BREAKDOWN OF {title}:",
            *(say(f"- {level.title()} Confidence {noun}: %d", count(f"{kind}_{level}")) for level in ("high", "medium", "low")),
            "", f"SUMMARY OF COMPLIANCE {summary}:", THIN, "",
        ]
        groups += [([10 * n + 1], [F.when(some, x) for x in opening]), ([10 * n + 3], [F.when(some, THIN), F.when(some, "")])]
    parts = [_lines(wide, groups)]

    summary_part = F.when(F.col("kind") == "issue", 2).otherwise(12)
    described = G.by_description(deduped)
    regulations = described.groupBy("doc_id", "kind", "regulation").agg(F.min("first_position").alias("group"))
    parts.append(_lines(regulations, [([summary_part, F.col("group"), 0], [say("%s:", F.col("regulation"))]), ([summary_part, F.col("group"), 1 << 40], [""])]))
    own = Window.partitionBy("doc_id", "kind", "regulation")
    bullet = say("  - %s%s (in %s, %s confidence)", F.col("description"), F.when(F.col("should_analyze"), "").otherwise(" (SKIPPED)"), T.display_sections(F.col("sections")), F.col("confidence"))
    parts.append(_lines(described.dropna(subset=["doc_id", "kind", "regulation"]).withColumn("group", F.min("first_position").over(own)), [([summary_part, F.col("group"), F.col("first_position")], [bullet])]))

    of_chunk = Window.partitionBy("doc_id", "chunk_index", "kind")
    listed = found.withColumns({"place": F.row_number().over(of_chunk.orderBy("ord")), "n_kind": F.count("*").over(of_chunk)})
    per_chunk = raw.repartition(tasks, "doc_id", "chunk_index").groupBy("doc_id", "chunk_index").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in TITLES))
    detail = chunk_results.repartition(tasks, "doc_id", "chunk_index").join(per_chunk, ["doc_id", "chunk_index"], "left").na.fill(0, ["n_issue", "n_point"])
    issues, points = F.col("n_issue") > 0, F.col("n_point") > 0
    no = lambda what: say(f"NO COMPLIANCE {what} DETECTED IN THIS%s SECTION", F.when(F.col("should_analyze"), "").otherwise(" SKIPPED"))
    title = say("SECTION #%d - %s%s", F.col("chunk_index") + 1, F.col("position"), F.when(F.col("should_analyze"), "").otherwise(" [SKIPPED]"))
    chunk = F.col("chunk_index")
    parts.append(_lines(detail, [
        ([31, chunk, 0], [title, THIN, "", "DOCUMENT TEXT:", F.col("text"), "", F.when(issues, "COMPLIANCE ISSUES:"), F.when(issues, "").otherwise(no("ISSUES"))]),
        ([31, chunk, 1 << 20], [F.when(issues, ""), F.when(issues, ""), F.when(points, "COMPLIANCE POINTS:"), F.when(points, "").otherwise(no("POINTS"))]),
        ([31, chunk, 1 << 30], ["", RULE, ""]),
    ]))
    last = F.col("place") == F.col("n_kind")
    base = F.when(F.col("kind") == "issue", 0).otherwise(1 << 20)
    named = F.when(F.col("kind") == "issue", TITLES["issue"][3]).otherwise(TITLES["point"][3])
    parts.append(_lines(listed, [([31, chunk, base + F.col("place")], [
        say("%s %d: %s", named, F.col("place"), T.without_asterisks(F.col("description"))), say("Regulation: %s", F.col("regulation")), say("Confidence: %s", F.col("confidence")),
        F.when(F.coalesce("citation", F.lit("")) != "", say("Citation: %s", T.display_citation(F.col("citation")))), F.when(~last, SHORT_RULE), F.when(~last, ""),
    ])]))
    everything = reduce(DataFrame.unionByName, parts).repartition(tasks, "doc_id")
    before = Window.partitionBy("doc_id").orderBy("at_0", "at_1", "at_2").rowsBetween(Window.unboundedPreceding, -1)
    numbered = everything.select("doc_id", F.coalesce(F.sum(F.size("lines")).over(before), F.lit(0)).alias("before"), "lines")
    return numbered.select("doc_id", "before", F.posexplode("lines").alias("n", "line")).select("doc_id", (F.col("before") + F.col("n") + 1).cast("int").alias("line_no"), "line")


def report_text(lines: DataFrame) -> DataFrame:
    """doc_id, report: the lines of each document as one text."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("report"))
