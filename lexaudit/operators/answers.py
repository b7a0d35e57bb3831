"""Answers of a judge: parsing into findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import ANSWER_BLOCK, ANSWER_FIELDS, ANSWER_KINDS, ANSWER_NOTHING, DEFAULT_CONFIDENCE, MARKS, UNKNOWN_ARTICLE, UNMARKED

#: Mark of an item.
_ITEM = MARKS[0]
_KINDS = ANSWER_KINDS


def without_fences(response: Column) -> Column:
    return F.regexp_replace(response, r"(?s)```.*?```", "")


def block(response: Column, kind: str) -> Column:
    """The part of an answer under the heading of ``kind``; empty if the answer says there is none."""
    heading = _KINDS[kind][0]
    end = r"(?:COMPLIANCE\s+POINTS:|\n?\z)" if kind == "issue" else r"\n?\z"
    text = F.regexp_extract(response, ANSWER_BLOCK.replace("@HEADING", heading).replace("@END", end), 1)
    return F.when(F.contains(response, F.lit(ANSWER_NOTHING.replace("@HEADING", heading))), "").otherwise(T.strip(text))


def items(text: Column) -> Column:
    """The numbered items. An item starts at a number, a dot and a space; it ends at any line that starts with a number and a dot."""
    pieces = F.split(F.regexp_replace(text, r"(?U)(^|\n)\s*\d+\.\s+", _ITEM), _ITEM, -1)
    cut = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: T.strip(F.regexp_replace(p, r"(?Us)\n\s*\d+\..*\z", "")))
    return cut


def _numbered(kind: str):
    return lambda item, n: F.struct(F.lit(kind).alias("kind"), n.alias("ord"), item.alias("item"))


def parse_answers(responses: DataFrame, kinds: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """Findings of the kinds asked for: doc_id, chunk_index, kind, ord, description, regulation, confidence, citation, explanation, section, should_analyze.

    ``responses`` has doc_id, chunk_index, position, should_analyze, response.
    """
    clean = responses.withColumn("response", without_fences(F.translate(F.coalesce("response", F.lit("")), MARKS, UNMARKED)))
    arrays = []
    for kind in kinds:
        _, heading, none, _ = _KINDS[kind]
        names = (heading, none)
        good = F.filter(items(block(F.col("response"), kind)), lambda i: (F.length(i) >= 10) & ~F.lower(i).isin(*names))
        arrays.append(F.transform(good, _numbered(kind)))
    rows = clean.select("doc_id", "chunk_index", "position", "should_analyze", F.inline(F.concat(*arrays)))
    dismissed = F.when(F.col("kind") == "issue", _KINDS["issue"][3]).otherwise(_KINDS["point"][3])
    description = T.describe_item(F.col("item"), dismissed)
    return rows.select(
        "doc_id", "chunk_index", "kind", F.col("ord").cast("int").alias("ord"), description.alias("description"), T.regulation_reference(F.col("item")).alias("regulation"),
        F.lit(DEFAULT_CONFIDENCE).alias("confidence"), T.first_quote(F.col("item")).alias("citation"), F.lit("").alias("explanation"), F.col("position").alias("section"), "should_analyze",
    )


def split_blocks(response: Column) -> tuple[Column, Column]:
    """(issues, points): what follows the first of each plain heading."""
    issues_at, points_at = F.lit("COMPLIANCE ISSUES:"), F.lit("COMPLIANCE POINTS:")
    after_issues = F.get(F.split(response, "COMPLIANCE ISSUES:", -1), 1)
    has_issues, has_points = F.contains(response, issues_at), F.contains(response, points_at)
    issues = F.when(has_issues & F.contains(after_issues, points_at), F.get(F.split(after_issues, "COMPLIANCE POINTS:", -1), 0)).when(has_issues & ~has_points, after_issues).otherwise("")
    points = F.when(has_issues, F.get(F.split(after_issues, "COMPLIANCE POINTS:", -1), 1)).when(has_points, F.get(F.split(response, "COMPLIANCE POINTS:", -1), 1)).otherwise("")
    return T.strip(F.coalesce(issues, F.lit(""))), T.strip(F.coalesce(points, F.lit("")))


def structured_items(text: Column, kind: str) -> Column:
    """Array of (title, regulation, confidence, explanation, citation) of blocks with the fields Article, Confidence, Explanation, Citation."""
    head = ANSWER_FIELDS.replace("@NAME", kind.upper())
    field = lambda n: F.regexp_extract_all(text, F.lit(head), F.lit(n))
    zipped = F.arrays_zip(field(1).alias("title"), field(2).alias("article"), field(3).alias("confidence"), field(4).alias("explanation"), field(5).alias("quoted"), field(6).alias("plain"))

    def finish(z: Column) -> Column:
        citation = T.strip(F.when(z["quoted"] != "", z["quoted"]).otherwise(z["plain"]))
        return F.struct(
            T.strip(z["title"]).alias("title"), T.format_article(T.strip(z["article"])).alias("regulation"), T.strip(z["confidence"]).alias("confidence"),
            T.strip(z["explanation"]).alias("explanation"), F.when((citation != "") & T.is_document_citation(citation), citation).alias("citation"),
        )

    return F.transform(zipped, finish)


def simple_items(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Items of a block read line by line: keys, item_ord, title, regulation, confidence, explanation, citation.

    A line that starts with a number and a dot or a bullet starts an item. Lines that start with the name of a field set it (the
    last one counts); other lines are added to the explanation, whose field line restarts it. Lines before the first item are dropped.
    """
    lines = blocks.select(*keys, F.posexplode(F.split("block", "\n", -1)).alias("line_no", "line")).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    starts = F.col("line").rlike(r"\A(\d+\.|[-*•])")
    order = Window.partitionBy(*keys).orderBy("line_no")
    kind = F.when(starts, "start").when(F.col("line").rlike(r"(?i)\A(Article|GDPR Article)"), "article").when(F.col("line").rlike(r"(?i)\AConfidence"), "confidence").when(F.col("line").rlike(r"(?i)\AExplanation"), "explanation").when(F.col("line").rlike(r"(?i)\ACitation"), "citation").otherwise("other")
    lines = lines.withColumn("item_ord", F.sum(F.when(starts, 1).otherwise(0)).over(order)).where("item_ord > 0").withColumn("field", kind)
    value = F.when(F.contains("line", F.lit(":")), T.strip(F.element_at(F.split("line", ":", 2), 2)))
    level = F.regexp_extract("line", r"(?i)(High|Medium|Low)", 1)
    quote = F.btrim(value, F.lit('"'))
    last = lambda c, when: F.max_by(F.when(when, c), F.when(when, F.col("line_no")))
    restart = F.max(F.when((F.col("field") == "explanation") & value.isNotNull(), F.col("line_no")))
    items_of = lines.groupBy(*keys, "item_ord").agg(
        F.max(F.when(F.col("field") == "start", F.col("line"))).alias("title"),
        F.coalesce(last(F.col("line"), F.col("field") == "article"), F.lit(UNKNOWN_ARTICLE)).alias("regulation"),
        F.coalesce(last(level, (F.col("field") == "confidence") & (level != "")), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        last(quote, (F.col("field") == "citation") & T.is_document_citation(quote)).alias("citation"),
        F.coalesce(last(value, (F.col("field") == "explanation") & value.isNotNull()), F.lit("")).alias("head"),
        F.coalesce(restart, F.lit(-1)).alias("restart"),
        F.sort_array(F.collect_list(F.when(F.col("field") == "other", F.struct("line_no", "line")))).alias("others"),
    )
    tail = F.transform(F.filter("others", lambda o: o["line_no"] > F.col("restart")), lambda o: F.concat(F.lit(" "), o["line"]))
    return items_of.select(*keys, F.col("item_ord").cast("int").alias("item_ord"), "title", "regulation", "confidence", F.concat("head", F.array_join(tail, "")).alias("explanation"), "citation")


def structured_findings(responses: DataFrame) -> DataFrame:
    """Findings of answers in fields: the columns of ``parse_answers``.

    ``responses`` has doc_id, chunk_index, position, should_analyze, response, and ``in_fields``: whether the fields are looked for. A block without
    fields, and every block of an answer that isn't in fields, is read line by line. A block that says there is nothing gives nothing.
    """
    issues, points = split_blocks(F.coalesce("response", F.lit("")))
    keys = ["doc_id", "chunk_index", "position", "should_analyze", "kind"]
    of = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("block"), structured_items(text, kind).alias("fields"))
    rows = responses.select(*keys[:-1], "in_fields", F.inline(F.array(of("issue", issues), of("point", points))))
    rows = rows.where(~F.col("block").rlike("No compliance (issues|points) found|No (issues|points) found"))
    has_fields = F.col("in_fields") & (F.size("fields") > 0)
    fielded = rows.where(has_fields).select(*keys, F.posexplode("fields").alias("ord", "v")).select(*keys, "ord", "v.*")
    plain = simple_items(rows.where(~has_fields), keys).withColumn("ord", F.col("item_ord") - 1).drop("item_ord")
    return fielded.unionByName(plain).select(
        "doc_id", "chunk_index", "kind", F.col("ord").cast("int").alias("ord"), F.col("title").alias("description"), "regulation", "confidence",
        F.coalesce("citation", F.lit("")).alias("citation"), "explanation", F.col("position").alias("section"), "should_analyze",
    )
