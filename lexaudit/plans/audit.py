"""The whole audit over a table of documents: sections, chunks, routing, retrieval, a judge, merged findings, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE, DEFAULT_DATA_TERMS, DEFAULT_REGULATORY_TERMS, RETRIEVED, RETRIEVED_BATCH
from ..operators import answers, documents, findings, judges, prompts, reports, retrieval, routing, violations
from ..operators.answer_store import AnswerStore
from ..sources import readers, report_files
from ..sources.tables import shared_path, written


@dataclass
class Framework:
    """A rule framework: its vocabulary and, optionally, its articles and patterns.

    A framework may replace the content indicators (text to a map), the scan for violations (chunk rows to the columns of
    ``scan_indicators``), the format of regulations (array of hits to text) and the prompt template; whatever it leaves out falls
    back to the defaults.
    """

    name: str
    data_terms: list[str] = field(default_factory=lambda: list(DEFAULT_DATA_TERMS))
    regulatory_terms: list[str] = field(default_factory=lambda: list(DEFAULT_REGULATORY_TERMS))
    articles: DataFrame | None = None
    patterns: DataFrame | None = None
    context: str = ""
    n_patterns: int = 0
    template: str = prompts.DEFAULT_TEMPLATE
    risk_level: str = "unknown"
    content_indicators: Callable[[Column], Column] | None = None
    scan_violations: Callable[[DataFrame], DataFrame] | None = None
    format_regulations: Callable[[Column], Column] | None = None


#: Frameworks by name.
REGISTRY: dict[str, Framework] = {}


def register(framework: Framework) -> Framework:
    REGISTRY[framework.name] = framework
    return framework


def framework(name: str) -> Framework:
    """A registered framework; an unknown name is an error that lists the others."""
    if name not in REGISTRY:
        raise ValueError(f"framework '{name}' not found; available: {', '.join(sorted(REGISTRY)) or 'none'}")
    return REGISTRY[name]


def load_framework(spark, name: str, folder: str) -> Framework:
    """A framework from a folder of articles.txt, common_patterns.txt, context.txt, data_terms.txt and regulatory_keywords.txt (all but articles optional)."""

    def text(file: str) -> DataFrame | None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.text(f"{folder}/{file}", wholetext=True).select(F.lit(name).alias("framework"), F.col("value").alias("text"))

    articles, patterns = text("articles.txt"), text("common_patterns.txt")
    if articles is None:
        raise FileNotFoundError(f"{folder}/articles.txt")
    lists = {}
    for kind in ("data_terms", "regulatory_keywords"):
        rows = text(f"{kind}.txt")
        parsed = readers.parse_terms(rows.select("framework", F.lit(kind).alias("term_type"), "text")) if rows is not None else None
        lists[kind] = readers.terms_of(parsed, name, kind) if parsed is not None else list(DEFAULT_DATA_TERMS if kind == "data_terms" else DEFAULT_REGULATORY_TERMS)
    context = text("context.txt")
    n_patterns = patterns.select(readers.count_patterns(F.col("text")).alias("n")).first().n if patterns is not None else 0
    return register(Framework(
        name, lists["data_terms"], lists["regulatory_keywords"], readers.parse_articles(articles), readers.parse_patterns(patterns) if patterns is not None else None,
        context.first().text if context is not None else "", n_patterns,
    ))


def routed_chunks(docs: DataFrame, rules: Framework, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP, progressive: bool = True, optimize: bool = True) -> DataFrame:
    """Chunks with scores and should_analyze. ``optimize``: sizes follow the documents' bytes. Not ``progressive``: every chunk is analysed."""
    rows = (docs if docs.isStreaming else readers.spread(docs)).withColumn("document_type", T.document_type(F.col("text")))
    if optimize:
        by_size, by_overlap = T.chunk_parameters(F.octet_length("text"), size, overlap)
        rows = rows.withColumns({"chunk_size": by_size, "chunk_overlap": by_overlap})
        parts = documents.chunks(documents.sections(rows), F.col("chunk_size"), F.col("chunk_overlap"))
    else:
        parts = documents.chunks(documents.sections(rows), F.lit(size), F.lit(overlap))
    routed = routing.route(parts, rules.data_terms, rules.regulatory_terms)
    return routed if progressive else routed.withColumn("should_analyze", F.lit(True))


def _violations(routed: DataFrame, rules: Framework) -> DataFrame:
    """The violations of the chunks to analyse, by the framework's own scan or by its patterns."""
    rows = routed.where("should_analyze").select("doc_id", "chunk_index", "position", "text")
    if rules.scan_violations:
        return rules.scan_violations(rows)
    if rules.patterns is None:
        none = routed.sparkSession.createDataFrame([], "pattern_ord int, indicator_ord int, pattern string, description string, indicator string, related_refs array<string>")
        return violations.scan_indicators(rows, none)
    return violations.scan_indicators(rows, violations.indicator_rows(rules.patterns))


def rule_audit(docs: DataFrame, rules: Framework, **options) -> tuple[DataFrame, DataFrame]:
    """(routed chunks, findings) without a model."""
    routed = routed_chunks(docs, rules, **options)
    return routed, judges.rule_findings(_violations(routed, rules))


def prompt_rows(routed: DataFrame, rules: Framework, embed: Callable[[Column], Column], k: int = RETRIEVED) -> DataFrame:
    """doc_id, chunk_index, position, text, should_analyze, prompt of the chunks to analyse: nearest articles, violations and indicators in one request."""
    # written once: articles, violations and the request itself each read the chunks, and would split and score the documents again
    asked = written(routed.where("should_analyze").select("doc_id", "chunk_index", "position", "text", "should_analyze"), shared_path(routed.sparkSession, "asked-chunks"))
    articles = rules.articles.withColumn("vector", embed(F.col("text")))
    nearest = retrieval.nearest(asked.withColumn("vector", embed(F.col("text"))), articles, ["doc_id", "chunk_index"], k)
    hits = retrieval.with_articles(nearest, rules.articles)
    return prompts.with_prompts(
        asked, hits, _violations(asked, rules), context=rules.context, n_patterns=rules.n_patterns, risk_level=rules.risk_level, template=rules.template,
        regulations=rules.format_regulations, indicators=rules.content_indicators,
    )


def model_audit(docs: DataFrame, rules: Framework, embed: Callable[[Column], Column], answer: Callable[[list[str]], list[str]], table: str | None = None, progressive: bool = True, rows_per_call: int = 4, store: AnswerStore | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(routed chunks, findings) of a judge that answers prompts.

    ``table``: where the answers are written before they are parsed. ``store``: where they are kept instead, so that a later audit asks only what is new.
    """
    spark = docs.sparkSession
    routed = routed_chunks(docs, rules, progressive=progressive, **options)
    requests = prompt_rows(routed, rules, embed, RETRIEVED if progressive else RETRIEVED_BATCH)
    judged = store.ask(requests, answer, rows_per_call) if store else judges.judge(requests, answer, rows_per_call)
    if table and not store:
        judged = written(judged, table)
    return routed, answers.parse_answers(judged)


def write_reports(docs: DataFrame, routed: DataFrame, raw: DataFrame, rules: Framework, json_path: str | None, text_path: str | None, date: str, progressive: bool | None = None, files_path: str | None = None) -> None:
    """The JSON reports (one line per document), the text reports (one row of text per document), and the text reports as files of their own (``files_path``)."""
    merged = findings.deduplicate(raw)
    described = documents.with_metadata(docs)
    if json_path:
        reports.report_json(described, merged, rules.name, progressive is not False).select("report").write.mode("overwrite").text(json_path)
    if not text_path and not files_path:
        return
    texts = reports.report_text(reports.report_lines(described, routed, raw, merged, rules.name, date, progressive))
    if text_path:
        texts.write.mode("overwrite").json(text_path)
    if files_path:
        names = report_files.file_names(docs, F.col("path") if "path" in docs.columns else F.col("doc_id").cast("string"))
        report_files.write_files(texts.join(names, "doc_id").select("name", F.col("report").alias("text")), files_path)
