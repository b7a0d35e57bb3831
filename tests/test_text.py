import pytest
from pyspark.sql import functions as F

from lexaudit.functions import text as T
from lexaudit.operators import answers, documents, findings, routing


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("Article 5(1)(e)", "5151"), ("Article 5(1)(f)", "5151"), ("Section 51", "5151"), ("Articles 15-20", "articles 1520"), ("Unknown Regulation", "unknown regulation"), ("", "unknown"), (None, "unknown")])
def test_normalize_regulation(spark, given, want):
    assert one(spark, given, T.normalize_regulation) == want


@pytest.mark.parametrize(("given", "want"), [("x (Article 5(1)(e)).", "Article 5(1)(e)"), ("x (Article 5(1)(f) and Article 32)", "Section 1"), ("violating Article 13(1).", "Section 1"), ("violating Article 9.", "Article 9"), ("none", "Unknown Regulation")])
def test_regulation_reference(spark, given, want):
    assert one(spark, given, T.regulation_reference) == want


def test_description_ends_at_the_first_quote(spark):
    assert one(spark, 'A, the right ("q r") stays', lambda c: T.describe_item(c, "This violates")) == "A, the right ("


@pytest.mark.parametrize(("n", "want"), [(9999, (10000, 0)), (10000, (5000, 500)), (49999, (5000, 500)), (50000, (2500, 250)), (199999, (2500, 250)), (200000, (500, 100))])
def test_chunk_parameters(spark, n, want):
    size, overlap = T.chunk_parameters(F.lit(n), 500, 100)
    assert tuple(spark.range(1).select(size, overlap).first()) == want


@pytest.mark.parametrize(("length", "score", "want"), [(99, 5, False), (1501, 0, True), (100, 3, True), (100, 2, False)])
def test_router(spark, length, score, want):
    assert one(spark, "x" * length, lambda c: routing.should_analyze(c, F.lit(score))) is want


@pytest.mark.parametrize(("names", "want"), [(["a"], "a"), (["a", "b"], "a, b"), (["a", "b", "c"], "a, b and 1 more")])
def test_display_sections(spark, names, want):
    assert spark.createDataFrame([(names,)], "s array<string>").select(T.display_sections(F.col("s")).alias("x")).first().x == want


def test_file_kind_rejects_other_files(spark):
    assert one(spark, "a/B.PDF", T.file_kind) == "pdf"
    with pytest.raises(Exception, match="Unsupported"):
        one(spark, "a.docx", T.file_kind)


def titles(spark, text):
    return [r.title for r in documents.sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("section_ord").collect()]


def test_headers(spark):
    assert titles(spark, "2.1 Sub") == ["Document"]
    text = "Intro\n1. A b\nBody.\n2.1 Sub\nbody\nDATA USE\nFoo bar\nbaz:\nzz"
    assert titles(spark, text)[:3] == ["Introduction/Header", "1. A b", "DATA USE"]
    assert titles(spark, "") == ["Document"]
    assert titles(spark, "1. One\n2. Two\n") == ["1. One"]


def test_paragraphs_stay_whole_and_in_order(spark):
    paragraphs = [f"paragraph {i} " + "x" * (37 * i % 400) for i in range(40)]
    docs = spark.createDataFrame([(1, "\n\n".join(paragraphs))], "doc_id int, text string")
    rows = documents.chunks(documents.sections(docs), F.lit(500), F.lit(0)).orderBy("chunk_index").collect()
    assert "\n\n".join(r.text for r in rows).split("\n\n") == [p.strip() for p in paragraphs]
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(len(r.text) <= 500 or "\n\n" not in r.text for r in rows)


def parsed(spark, response):
    rows = spark.createDataFrame([(1, 0, "S", True, response)], "doc_id int, chunk_index int, position string, should_analyze boolean, response string")
    return [(r.kind, r.description) for r in answers.parse_answers(rows).orderBy("kind", "ord").collect()]


def test_answers(spark):
    assert parsed(spark, "```\nCOMPLIANCE ISSUES:\n1. all of it is fenced\n```") == []
    assert parsed(spark, "NO COMPLIANCE ISSUES DETECTED\nCOMPLIANCE POINTS:\n1. the one point it has") == [("point", "the one point it has")]
    assert parsed(spark, "COMPLIANCE ISSUES:\n1. first long item\n3.5 ends it\n2. second long item") == [("issue", "first long item"), ("issue", "second long item")]
    assert parsed(spark, None) == []


def test_merging_prefers_the_first_analysed(spark):
    rows = [(1, 0, "issue", 0, "Same thing", "Article 5", "Low", "", "old", "A", False), (1, 1, "issue", 0, "the same thing", "Article 5", "HIGH", '"q"', "new", "B", True), (1, 2, "issue", 0, "same thing!", "Article 5", "HIGH", '"r"', "newer", "A", True)]
    schema = "doc_id int, chunk_index int, kind string, ord int, description string, regulation string, confidence string, citation string, explanation string, section string, should_analyze boolean"
    merged = findings.deduplicate(spark.createDataFrame(rows, schema)).collect()
    assert len(merged) == 1
    r = merged[0]
    assert (r.description, r.confidence, r.citation, r.explanation, r.sections, r.should_analyze, r.n_merged) == ("Same thing", "HIGH", '"q"', "new", ["A", "B"], True, 3)
