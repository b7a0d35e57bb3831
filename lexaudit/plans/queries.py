"""The registered query of each operator, over generated corpora and the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import CONTENT_INDICATORS, DEFAULT_DATA_TERMS, DEFAULT_MODEL, DEFAULT_REGULATORY_TERMS, FRAMEWORK_FILES
from ..operators import answers, contradictions, documents, findings, json_answers, judges, prompts, reports, retrieval, routing, violations
from ..operators.answer_store import AnswerStore
from ..sources import pdf, readers
from ..sources.tables import shared_path, written
from . import audit
from . import corpus as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(s: SparkSession, d: str) -> DataFrame:
    return C.build(s, d, C.AUDIT_DOCS)


def _responses(s: SparkSession, d: str) -> DataFrame:
    return C.build(s, d, C.AUDIT_RESPONSES)


def _findings(s: SparkSession, d: str) -> DataFrame:
    return C.build(s, d, C.AUDIT_FINDINGS)


def _sections(s: SparkSession, d: str) -> DataFrame:
    return documents.sections(_docs(s, d).withColumn("document_type", T.document_type(F.col("text"))))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return documents.chunks(_sections(s, d), F.lit(500), F.lit(100))


def _terms(s: SparkSession) -> DataFrame:
    files = C.literal(s, framework="demo", term_type="data_terms", text=C.TERMS).union(C.literal(s, framework="demo", term_type="regulatory_keywords", text=C.KEYWORDS))
    return readers.parse_terms(files)


def _routed(s: SparkSession, d: str) -> DataFrame:
    terms = _terms(s)
    return routing.route(_chunks(s, d), readers.terms_of(terms, "demo", "data_terms"), readers.terms_of(terms, "demo", "regulatory_keywords"))


def _indicators(s: SparkSession) -> DataFrame:
    return violations.indicator_rows(readers.parse_patterns(C.literal(s, framework="demo", text=C.PATTERNS)))


def _joined(*columns: str) -> list:
    """Arrays as texts, for comparison across engines."""
    return [F.array_join(c, "|").alias(c) for c in columns]


@query
def doc_type(s, d):
    return _docs(s, d).select("doc_id", T.document_type(F.col("text")).alias("document_type"))


@query
def data_mentions(s, d):
    return _docs(s, d).select("doc_id", F.array_join(T.data_mentions(F.col("text")), "|").alias("mentions"))


@query
def compliance_indicators(s, d):
    return _docs(s, d).select("doc_id", F.array_join(T.compliance_words(F.col("text")), "|").alias("mentions"))


@query
def content_indicators(s, d):
    return _docs(s, d).select("doc_id", *(T.content_indicator(F.col("text"), n).alias(n) for n in CONTENT_INDICATORS))


@query
def indicator_bullets(s, d):
    return _docs(s, d).select("doc_id", T.indicator_bullets(T.content_indicators(F.col("text"))).alias("bullets"))


@query
def chunk_params(s, d):
    size, overlap = T.chunk_parameters(F.octet_length("text"), 500, 100)
    return C.table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), size.alias("chunk_size"), overlap.alias("chunk_overlap"))


@query
def preview(s, d):
    return C.table(s, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query
def file_dispatch(s, d):
    """Every fifth document is a PDF file by its name."""
    named = _docs(s, d).withColumn("path", F.when(F.col("doc_id") % 5 == 0, F.concat("path", F.lit(".Pdf"))).otherwise(F.col("path")))
    return named.select("doc_id", T.file_kind(F.col("path")).alias("kind"), T.basename(F.col("path")).alias("document"), "n_bytes")


@query
def sections(s, d):
    return _sections(s, d).select("doc_id", "section_ord", "title", "text", "level")


@query
def section_levels(s, d):
    return _sections(s, d).groupBy("level").agg(F.count("*").alias("n_sections"), F.count_distinct("doc_id").alias("n_docs"))


@query
def intro_sections(s, d):
    return _sections(s, d).where("title in ('Introduction/Header', 'Document')").select("doc_id", "title", "text")


@query
def chunk_pack(s, d):
    return documents.chunks(_sections(s, d), F.lit(500), F.lit(0)).select("doc_id", "chunk_index", "position", "text", "level", "document_type")


@query
def chunk_pack_overlap(s, d):
    return _chunks(s, d).select("doc_id", "chunk_index", "position", "text", "level", "document_type")


@query
def chunk_lines_overlap(s, d):
    """Raw documents, whose lines are the paragraphs."""
    lines = C.table(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.lit("Document").alias("title"), F.lit(0).alias("level"), F.lit(0).alias("section_ord"))
    return documents.chunks(lines, F.lit(2500), F.lit(250)).select("doc_id", "chunk_index", "position", "text")


@query
def chunk_tiers(s, d):
    """The size of chunks follows the size of the document."""
    size, overlap = T.chunk_parameters(F.col("n_bytes") * 20, 500, 100)
    rows = documents.sections(_docs(s, d).withColumns({"size": size, "overlap": overlap}))
    return documents.chunks(rows, F.col("size") / 10, F.col("overlap")).select("doc_id", "chunk_index", "position", F.length("text").alias("n_chars"))


@query
def page_join(s, d):
    pages = C.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")
    return readers.join_pages(pages)


@query
def pdf_pages(s, d):
    """Conversations as PDF files, read back: each turn is a page."""
    pages = pdf.pdf_pages(C.conversation_files(s, d))
    return pages.select(F.split_part("doc_id", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), "text")


@query
def pdf_join(s, d):
    pages = pdf.pdf_pages(C.conversation_files(s, d)).withColumn("doc_id", F.split_part("doc_id", F.lit("."), F.lit(1)).cast("long"))
    return readers.join_pages(pages)


@query
def term_scan(s, d):
    return readers.parse_terms(C.build(s, d, C.TERM_FILES)).select("framework", "term_type", F.col("term_ord").cast("long").alias("term_ord"), "term")


@query
def term_score(s, d):
    return _routed(s, d).select("doc_id", "chunk_index", "data_score", "regulatory_score", "total_score")


@query
def route(s, d):
    return _routed(s, d).select("doc_id", "chunk_index", "should_analyze")


@query
def route_documents(s, d):
    """The router over raw documents with the default term lists."""
    routed = routing.route(C.table(s, d, "documents").select("doc_id", "text"), DEFAULT_DATA_TERMS, DEFAULT_REGULATORY_TERMS)
    return routed.groupBy("total_score", "should_analyze").agg(F.count("*").alias("n"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))


@query
def route_partition(s, d):
    return _routed(s, d).groupBy("doc_id").agg(F.count_if("should_analyze").alias("analyzed"), F.count_if(~F.col("should_analyze")).alias("skipped"), F.bool_or("should_analyze").alias("any_analyzed"))


@query
def skip_union(s, d):
    """Analysed chunks have an issue and skipped ones none, from one read of the chunks."""
    return _routed(s, d).select("doc_id", "chunk_index", "position", "should_analyze", F.when(F.col("should_analyze"), 1).otherwise(0).alias("n_issues"))


@query
def batching(s, d):
    return routing.batches(_chunks(s, d), 4).select("doc_id", "chunk_index", "batch_no", "n_batches")


@query
def term_join(s, d):
    return routing.join_terms(_chunks(s, d), _terms(s).select("term_type", "term")).groupBy("doc_id", "chunk_index", "term_type").agg(F.count("*").alias("score"))


@query
def pattern_parse(s, d):
    rows = readers.parse_patterns(C.build(s, d, C.PATTERN_FILES))
    return rows.select("framework", "pattern_ord", "pattern", "description", *_joined("indicators", "related_refs"))


@query
def pattern_count(s, d):
    return C.build(s, d, C.PATTERN_FILES).select("framework", readers.count_patterns(F.col("text")).cast("long").alias("n_patterns"))


@query
def article_parse(s, d):
    return readers.parse_articles(C.build(s, d, C.ARTICLE_FILES)).select("framework", "art_ord", "id", "title", "text")


@query
def concept_tag(s, d):
    return _docs(s, d).select("doc_id", F.array_join(readers.concepts(F.col("text")), "|").alias("concepts"))


@query
def concept_bag(s, d):
    return readers.parse_articles(C.build(s, d, C.ARTICLE_FILES)).select("framework", "art_ord", *_joined("related_concepts"))


@query
def indicator_scan(s, d):
    found = violations.scan_indicators(_chunks(s, d), _indicators(s))
    return found.select("doc_id", "chunk_index", "pattern_ord", "indicator_ord", "pattern", "description", "indicator", "context", *_joined("related_refs"))


@query
def top5_violations(s, d):
    whole = _docs(s, d).select("doc_id", F.lit(0).alias("chunk_index"), "text")
    return violations.top_violations(violations.scan_indicators(whole, _indicators(s))).select("doc_id", "rank", "pattern_ord", "indicator_ord", "indicator")


@query
def benchmark_needles(s, d):
    """benchmark items as indicators over raw documents."""
    needles = C.table(s, d, "benchmark").select(F.col("item_id").alias("pattern_ord"), F.lit(0).alias("indicator_ord"), F.lit("item").alias("pattern"), F.lit("").alias("description"), F.col("text").alias("indicator"), F.array().cast("array<string>").alias("related_refs"))
    rows = C.table(s, d, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    return violations.scan_indicators(rows, needles).select("doc_id", "pattern_ord", "context")


def _articles(s: SparkSession, d: str) -> DataFrame:
    """One vector of each label stands for an article."""
    first = C.table(s, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"), F.min("vec_id").alias("source"))
    return first.select(F.col("label").alias("art_ord"), "vector", F.concat(F.lit("Article "), F.col("label").cast("string")).alias("id"), F.lit("").alias("title"), F.lit("text").alias("text"), F.array(F.lit("data")).alias("related_concepts"))


def _nearest(s: SparkSession, d: str, k: int) -> DataFrame:
    return retrieval.nearest(C.table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), _articles(s, d), ["vec_id"], k)


@query
def knn_top3(s, d):
    return _nearest(s, d, 3).select("vec_id", "rank", "art_ord", "distance")


@query
def knn_top5(s, d):
    return _nearest(s, d, 5).select("vec_id", "rank", "art_ord", "distance")


@query
def knn_join_meta(s, d):
    return retrieval.with_articles(_nearest(s, d, 5), _articles(s, d)).select("vec_id", "rank", "id", "title", *_joined("related_concepts"))


@query
def doc_meta_join(s, d):
    return documents.chunks(documents.sections(_docs(s, d)), F.lit(500), F.lit(100)).select("doc_id", "chunk_index").join(_docs(s, d).select("doc_id", T.document_type(F.col("text")).alias("document_type")), "doc_id")


@query
def model_lookup(s, d):
    """Each market segment asks for a model by its name in lower case; unknown names get the default."""
    wanted = C.table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "large").when(F.col("c_custkey") % 4 == 1, "medium").otherwise(F.lower("c_mktsegment")).alias("asked"))
    catalogue = readers.models(s)
    default = catalogue.where(F.col("key") == DEFAULT_MODEL).select(*(F.col(c).alias(f"default_{c}") for c in catalogue.columns))
    joined = wanted.join(F.broadcast(catalogue), wanted["asked"] == catalogue["key"], "left").join(F.broadcast(default))
    return joined.select("c_custkey", *(F.coalesce(c, f"default_{c}").alias(c) for c in ("key", "name", "batch_size", "context_window", "temperature")))


@query
def models(s, d):
    """Each model, and how many customers ask for it by its key."""
    asked = C.table(s, d, "customer").groupBy(F.when(F.col("c_custkey") % 4 == 0, "large").when(F.col("c_custkey") % 4 == 1, "medium").otherwise(F.lower("c_mktsegment")).alias("key")).agg(F.count("*").alias("n_customers"))
    return readers.models(s).join(asked, "key", "left").na.fill(0, ["n_customers"])


@query
def framework_files(s, d):
    """Nations stand for frameworks; every third customer stands for a file that his nation has."""
    frameworks = C.table(s, d, "nation").select(F.col("n_name").alias("id"), "n_nationkey")
    files = F.array(*map(F.lit, FRAMEWORK_FILES))
    held = C.table(s, d, "customer").where("c_custkey % 3 = 0").select("c_nationkey", F.get(files, (F.col("c_custkey") % len(FRAMEWORK_FILES)).cast("int")).alias("file"))
    present = held.join(frameworks, held["c_nationkey"] == frameworks["n_nationkey"]).select("id", "file")
    return readers.missing_files(frameworks.select("id"), present)


@query
def regulation_norm(s, d):
    return _findings(s, d).select("doc_id", "chunk_index", T.normalize_regulation(F.col("regulation")).alias("norm"), T.normalize_regulation(F.col("regulation"), compat=False).alias("norm_plain"))


@query
def text_norm(s, d):
    return _findings(s, d).select("doc_id", "chunk_index", T.normalize_text(F.col("description")).alias("norm"))


@query
def dedup_key(s, d):
    return _findings(s, d).select("doc_id", "chunk_index", T.dedup_key(F.col("regulation"), F.col("description")).alias("key"))


@query
def extract_quote(s, d):
    return _responses(s, d).select("doc_id", "chunk_index", T.first_quote(F.col("response")).alias("quote"))


@query
def extract_regulation(s, d):
    return _findings(s, d).select("doc_id", "chunk_index", T.regulation_reference(F.col("description")).alias("regulation"))


@query
def citation_cleanup(s, d):
    return _findings(s, d).select("doc_id", "chunk_index", T.display_citation(F.when(F.col("chunk_index") % 5 == 0, "None").when(F.col("chunk_index") % 5 == 1, "bare words").otherwise(F.col("citation"))).alias("shown"))


@query
def format_article(s, d):
    return _findings(s, d).select("doc_id", "chunk_index", T.format_article(F.when(F.col("chunk_index") % 6 == 0, "12").when(F.col("chunk_index") % 6 == 1, "Art. 9(2)(a)").when(F.col("chunk_index") % 6 == 2, "voice").otherwise(F.col("regulation"))).alias("article"))


@query
def doc_citation_pred(s, d):
    return _findings(s, d).select("doc_id", "chunk_index", T.is_document_citation(F.when(F.col("chunk_index") % 2 == 0, F.col("description")).otherwise(F.col("citation"))).alias("is_document"))


@query
def strip_asterisks(s, d):
    return _findings(s, d).select("doc_id", "chunk_index", T.without_asterisks(F.concat(F.lit("**"), F.col("regulation"), F.lit("** *x*"))).alias("clean"))


@query
def fence_strip(s, d):
    return _responses(s, d).select("doc_id", "chunk_index", answers.without_fences(F.col("response")).alias("clean"))


@query
def no_issue_marker(s, d):
    return _responses(s, d).select("doc_id", "chunk_index", (answers.block(F.col("response"), "issue") == "").alias("no_issues"), (answers.block(F.col("response"), "point") == "").alias("no_points"))


_PARSED = ("doc_id", "chunk_index", "ord", "description", "regulation", "confidence", "citation", "section", "should_analyze")


@query
def parse_issues(s, d):
    return answers.parse_answers(_responses(s, d), ("issue",)).select(*_PARSED)


@query
def parse_points(s, d):
    return answers.parse_answers(_responses(s, d), ("point",)).select(*_PARSED)


@query
def direct_blocks(s, d):
    rows = C.build(s, d, C.AUDIT_STRUCTURED)
    issues, points = answers.split_blocks(F.col("response"))
    return rows.select("doc_id", issues.alias("issues"), points.alias("points"))


@query
def structured_parse(s, d):
    rows = C.build(s, d, C.AUDIT_STRUCTURED)
    issues, _ = answers.split_blocks(F.col("response"))
    return rows.select("doc_id", F.inline(answers.structured_items(issues, "issue")))


@query
def simple_items(s, d):
    rows = C.build(s, d, C.AUDIT_STRUCTURED)
    issues, points = answers.split_blocks(F.col("response"))
    blocks = rows.select("doc_id", F.explode(F.array(F.struct(F.lit("issue").alias("kind"), issues.alias("block")), F.struct(F.lit("point").alias("kind"), points.alias("block")))).alias("b")).select("doc_id", "b.*")
    return answers.simple_items(blocks, ["doc_id", "kind"])


@query
def restructure(s, d):
    """A second request puts answers into fields; where it fails, the first answer is read line by line."""

    def answer(texts: list[str]) -> list[str]:
        if any("All good" in t for t in texts):
            raise RuntimeError("the judge is down")
        return texts

    judged = C.build(s, d, C.AUDIT_STRUCTURED).select("doc_id", F.lit(0).alias("chunk_index"), F.lit("Document").alias("position"), F.lit(True).alias("should_analyze"), "response", F.lit(None).cast("string").alias("error"))
    return judges.restructure(judged, answer, template="{response}").select("doc_id", "kind", "ord", "description", "regulation", "confidence", "citation", "explanation")


@query
def json_findings(s, d):
    """Good, fenced, cut off and broken answers in JSON."""
    found = json_answers.parse_json_answers(C.build(s, d, C.AUDIT_JSON))
    return found.select("doc_id", "chunk_index", "ord", "description", "regulation", "confidence", "citation", "explanation", "section", "repaired", *_joined("tags"))


@query
def contradiction_pairs(s, d):
    pairs = contradictions.candidate_pairs(json_answers.parse_json_answers(C.build(s, d, C.AUDIT_JSON)))
    return pairs.select("doc_id", "earlier_chunk", "earlier_ord", "earlier_section", "earlier_description", "later_chunk", "later_ord", "later_section", "later_description", *_joined("tags"))


@query
def stored_answers(s, d):
    """Requests of every second document are answered first, then those of all: what was kept is not asked again."""
    rows = _responses(s, d).select("doc_id", "chunk_index", "position", "should_analyze", F.substring("response", 1, 200).alias("prompt"))
    store = AnswerStore(s, shared_path(s, "answers"))
    answer = lambda texts: [f"{len(t)} {t[:30]}" for t in texts]
    store.ask(rows.where("doc_id % 2 = 0"), answer, 100)
    return store.ask(rows, answer, 100, slices=2).select("doc_id", "chunk_index", "should_analyze", "response", "kept")


def _deduped(s: SparkSession, d: str) -> DataFrame:
    return findings.deduplicate(_findings(s, d))


_MERGED = ("doc_id", "key", "description", "regulation", "confidence", "citation", "explanation", "should_analyze", "n_merged")


@query
def dedup_issues(s, d):
    return _deduped(s, d).where("kind = 'issue'").select(*_MERGED)


@query
def dedup_points(s, d):
    return _deduped(s, d).where("kind = 'point'").select(*_MERGED)


@query
def section_union(s, d):
    return _deduped(s, d).select("doc_id", "kind", "key", *_joined("sections"))


@query
def section_display(s, d):
    return _deduped(s, d).select("doc_id", "kind", "key", T.display_sections(F.col("sections")).alias("shown"))


@query
def dedup_counts(s, d):
    return findings.counts(_findings(s, d))


@query
def confidence_breakdown(s, d):
    return findings.confidence_breakdown(_deduped(s, d))


@query
def finding_rollups(s, d):
    return findings.rollups(_deduped(s, d))


@query
def by_regulation(s, d):
    return findings.by_regulation(_deduped(s, d))


@query
def by_regulation_issue(s, d):
    return findings.by_description(_deduped(s, d)).select("doc_id", "kind", "regulation", "description", *_joined("sections"), "confidence", "should_analyze", "first_position")


@query
def sorted_findings(s, d):
    return findings.in_order(_deduped(s, d)).select("doc_id", "kind", "position", "key")


@query
def summary_sentence(s, d):
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return _deduped(s, d).groupBy("doc_id").agg(T.summary_sentence(n("issue"), n("point"), "demo").alias("summary"))


@query
def detected_patterns(s, d):
    rows = _findings(s, d).select("doc_id", "chunk_index", F.array(F.concat(F.col("kind"), F.lit(": '"), F.col("regulation"), F.lit("' ")), F.lit("no colon"), F.concat(F.lit(" a : b: "), F.col("section"))).alias("detected"))
    return violations.detected_patterns(rows).select("doc_id", "chunk_index", "pattern", "indicator", "context")


@query
def finding_defaults(s, d):
    chunks = _responses(s, d).select("doc_id", "chunk_index", F.col("position"), F.col("response").alias("text"), "should_analyze")
    bare = _findings(s, d).withColumns({"section": F.when(F.col("chunk_index") % 2 == 0, F.col("section")), "should_analyze": F.when(F.col("chunk_index") % 3 == 0, F.lit(False))})
    return findings.with_defaults(bare, chunks).select("doc_id", "chunk_index", "section", "text", "should_analyze")


@query
def first_issues(s, d):
    merged = _findings(s, d).withColumns({"ord": F.col("chunk_index"), "chunk_index": F.lit(0)})
    return findings.first_issues(merged).select("doc_id", "kind", "place", "ord", "description")


@query
def labels_breakdown(s, d):
    return C.table(s, d, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query
def format_regulations(s, d):
    hits = readers.parse_articles(C.build(s, d, C.ARTICLE_FILES)).groupBy("framework").agg(F.sort_array(F.collect_list(F.struct("art_ord", "id", "title", "text", "related_concepts"))).alias("hits"))
    rows = F.transform("hits", lambda h: F.struct(h["id"].alias("id"), h["title"].alias("title"), h["text"].alias("text"), h["related_concepts"].alias("related_concepts")))
    return hits.select("framework", prompts.format_regulations(rows, n_patterns=4).alias("regulations"))


def _audit(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(routed chunks, merged findings) of the rule judge."""
    routed = _routed(s, d)
    found = violations.scan_indicators(routed.where("should_analyze").select("doc_id", "chunk_index", "position", "text"), _indicators(s))
    return routed, judges.rule_findings(found)


@query
def rule_findings(s, d):
    return _audit(s, d)[1].select("doc_id", "chunk_index", "ord", "description", "regulation", "citation", "section")


@query
def audit_summary(s, d):
    """Documents to sections, chunks, routing, indicators, rule findings, merged and counted per regulation."""
    _, raw = _audit(s, d)
    merged = findings.deduplicate(raw)
    level = lambda name: F.count_if(F.upper("confidence") == name).alias(name.lower())
    return merged.groupBy("doc_id", "regulation").agg(F.count("*").alias("n_issues"), level("HIGH"), level("MEDIUM"), level("LOW"), F.sum(F.size("sections")).alias("n_sections"))


def _report_findings(s: SparkSession, d: str) -> DataFrame:
    """Issues and points of all confidences, of analysed and skipped chunks, several in a chunk."""
    return C.build(s, d, C.REPORT_FINDINGS)


@query
def report_json(s, d):
    docs = _docs(s, d).withColumn("document_type", T.document_type(F.col("text")))
    return reports.report_json(docs, findings.deduplicate(_report_findings(s, d)), "demo")


@query
def report_lines(s, d):
    raw = _report_findings(s, d)
    return reports.report_lines(documents.with_metadata(_docs(s, d)), C.build(s, d, C.REPORT_CHUNKS), raw, findings.deduplicate(raw), "demo", "2024-01-01 00:00:00")


def _rules(s: SparkSession, **options) -> audit.Framework:
    articles = readers.parse_articles(C.literal(s, framework="demo", text=C.ARTICLES))
    patterns = readers.parse_patterns(C.literal(s, framework="demo", text=C.PATTERNS))
    return audit.Framework("demo", articles=articles, patterns=patterns, context="Rules on data.", n_patterns=4, **options)


def _shape(text: F.Column) -> F.Column:
    """A vector of a text that every engine computes alike: its length in two parts."""
    n = F.length(text)
    return F.array((n % 13).cast("double"), (n / 40).cast("long").cast("double"))


@query
def prompt_build(s, d):
    """Routed chunks with their five nearest articles, violations and the guidance for high risk."""
    return audit.prompt_rows(_routed(s, d), _rules(s, risk_level="high"), _shape).select("doc_id", "chunk_index", "prompt")


@query
def prompt_hooks(s, d):
    """A framework with its own content indicators, scan for violations, format of regulations and template."""

    def scan(rows: DataFrame) -> DataFrame:
        none = F.array().cast("array<string>")
        hit = rows.where(F.contains(F.lower("text"), F.lit("encryption")))
        return hit.select("*", F.lit(0).alias("pattern_ord"), F.lit(0).alias("indicator_ord"), F.lit("Own scan").alias("pattern"), F.lit("").alias("description"), F.lit("encryption").alias("indicator"), F.lit("own").alias("context"), none.alias("related_refs"))

    rules = _rules(
        s, template="{section}|{regulations}|{indicators}|{violations}|{guidance}", risk_level="low", scan_violations=scan,
        content_indicators=lambda text: F.create_map(F.lit("has_mail"), F.when(F.contains(F.lower(text), F.lit("email")), "Yes").otherwise("No")),
        format_regulations=lambda hits: F.array_join(F.transform(hits, lambda h: F.upper(h["id"])), ";"),
    )
    return audit.prompt_rows(_routed(s, d), rules, _shape).select("doc_id", "chunk_index", "prompt")


@query
def model_audit(s, d):
    """Sections to findings with a judge that names the length of its request, so that the whole request counts."""

    def answer(texts: list[str]) -> list[str]:
        return [f'COMPLIANCE ISSUES:\n1. The request has {len(t)} characters (Article {len(t) % 9 + 1}). "{len(t)} of them"\nCOMPLIANCE POINTS:\n1. It was read as a whole EXPLANATION: nothing is cut (Rule {len(t) % 7}).' for t in texts]

    rules = _rules(s)
    rules.data_terms, rules.regulatory_terms = (readers.terms_of(_terms(s), "demo", kind) for kind in ("data_terms", "regulatory_keywords"))
    _, raw = audit.model_audit(_docs(s, d), rules, _shape, answer, size=500, overlap=100, optimize=False)
    return raw.select("doc_id", "chunk_index", "kind", "description", "regulation", "citation", "section")


@query
def canned_judge(s, d):
    """A batch judge on the executors, with a failing row, parsed and merged."""
    routed = _routed(s, d).select("doc_id", "chunk_index", "position", "should_analyze", F.col("text").alias("prompt"))

    def answer(texts: list[str]) -> list[str]:
        if any("audit" in t for t in texts):
            raise RuntimeError("the judge is down")
        return [f'COMPLIANCE ISSUES:\n1. The section is {len(t)} characters long (Article {len(t) % 9 + 1}). "{t[:20].split(chr(10))[0]}"' for t in texts]

    judged = written(judges.judge(routed, answer), shared_path(s, "canned-answers"))
    parsed = findings.deduplicate(answers.parse_answers(judged))
    failed = judged.groupBy("doc_id").agg(F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.count("*").alias("n_chunks"))
    return failed.join(parsed.groupBy("doc_id").agg(F.count("*").alias("n_findings")), "doc_id", "left").na.fill(0)
