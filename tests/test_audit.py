from lexaudit.operators import retrieval
from lexaudit.plans import audit
from lexaudit.plans import corpus as C
from lexaudit.sources import readers
from lexaudit.streaming import audit_stream as stream

from .oracle import DATA


def rules(spark):
    return audit.Framework("demo", articles=readers.parse_articles(C.literal(spark, framework="demo", text=C.ARTICLES)), patterns=readers.parse_patterns(C.literal(spark, framework="demo", text=C.PATTERNS)))


def test_files_to_reports(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    (docs / "a.txt").write_text("1. Storage\n" + "All personal data of a user is retained indefinitely by the system. " * 3)
    (docs / "b.md").write_text("nothing here")
    rows = readers.read_documents(spark, str(docs))
    assert {r.n_bytes for r in rows.collect()} == {(docs / "a.txt").stat().st_size, 12}
    routed, raw = audit.rule_audit(rows, rules(spark))
    audit.write_reports(rows, routed, raw, rules(spark), str(tmp_path / "json"), str(tmp_path / "text"), "2024-01-01 00:00:00")
    reports = "\n".join(r.value for r in spark.read.text(str(tmp_path / "json")).collect())
    assert "1 potential compliance issue(s)" in reports and '"section":"1. Storage"' in reports
    text = {r.doc_id.rsplit("/", 1)[1]: r.report for r in spark.read.json(str(tmp_path / "text")).collect()}
    assert "SECTION #1 - 1. Storage" in text["a.txt"] and "Total Issues Found: 1" in text["a.txt"]
    assert "NO COMPLIANCE ISSUES DETECTED IN THIS SKIPPED SECTION" in text["b.md"]


def test_framework_folder(spark, tmp_path):
    (tmp_path / "articles.txt").write_text(C.ARTICLES)
    (tmp_path / "data_terms.txt").write_text(C.TERMS)
    loaded = audit.load_framework(spark, "folder", str(tmp_path))
    assert loaded.articles.count() == 6 and "personal data" in loaded.data_terms and "compliance" in loaded.regulatory_terms and loaded.patterns is None
    assert audit.framework("folder") is loaded


def test_model_audit_with_canned_answers(spark, tmp_path):
    docs = C.build(spark, DATA, C.AUDIT_DOCS).limit(20)
    embed = retrieval.hashed_embedding()

    def answer(texts):
        assert all("RELEVANT REGULATIONS" in t for t in texts)
        return ['COMPLIANCE ISSUES:\n1. It keeps too much (Article 5). "keeps"' for _ in texts]

    routed, raw = audit.model_audit(docs, rules(spark), embed, answer, str(tmp_path / "answers"))
    assert raw.count() == routed.where("should_analyze").count() > 0
    assert {r.regulation for r in raw.collect()} == {"Article 5"}


def test_routed_and_skipped_are_all(spark):
    docs = C.build(spark, DATA, C.AUDIT_DOCS)
    routed = audit.routed_chunks(docs, rules(spark), optimize=False)
    assert routed.where("should_analyze").count() + routed.where("not should_analyze").count() == routed.count()
    everything = audit.routed_chunks(docs, rules(spark), progressive=False)
    assert everything.where("not should_analyze").count() == 0


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text("1. Terms\nUsers must agree to the collection of personal data and information, or leave the service for good.\n")
    docs = stream.read_document_stream(spark, str(folder))
    assert stream.routed_parts(docs, rules(spark)).isStreaming
    q = stream.audit_stream(docs, rules(spark), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    routed, raw = audit.rule_audit(docs, rules(spark))
    assert routed.count() == 0 and raw.count() == 0


def test_plans(spark):
    """Routing needs no shuffle before chunks are numbered, and only the read columns are scanned."""
    from lexaudit.plans.queries import QUERIES

    plan = QUERIES["doc_type"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "c_acctbal" not in plan
    routed = QUERIES["route"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert routed.count("Exchange hashpartitioning(doc_id") <= 1 and "Python" not in routed
    whole = QUERIES["audit_summary"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in whole


def test_long_term_lists_give_the_same_matches(spark):
    from lexaudit.operators import routing

    rows = spark.createDataFrame([(1, 0, "Personal data of a user; API and pia in dpia"), (2, 0, ""), (3, 0, None), (4, 0, "ab")], "doc_id int, chunk_index int, text string")
    terms = spark.createDataFrame([("t", x) for x in ("personal data", "user", "API", "pia", "dpia", "a", "ab", "data")], "term_type string, term string")
    pairs = lambda df: sorted((r.doc_id, r.term) for r in df.collect())
    assert pairs(routing.join_terms(rows, terms)) == [(1, "a"), (1, "data"), (1, "dpia"), (1, "personal data"), (1, "pia"), (1, "user"), (4, "a"), (4, "ab")]


def test_fewer_articles_than_asked_for(spark):
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "id int, vector array<float>")
    articles = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "art_ord int, vector array<float>")
    got = [tuple(r) for r in retrieval.nearest(queries, articles, ["id"], 5).orderBy("id", "rank").collect()]
    assert got == [(1, 1, 0, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 4.0)]
    assert retrieval.nearest(queries, articles.limit(0), ["id"], 5).count() == 0


def test_command_line(spark, tmp_path, capsys):
    import json

    from lexaudit.__main__ import main

    kb = tmp_path / "kb"
    (kb / "demo").mkdir(parents=True)
    (kb / "demo" / "articles.txt").write_text(C.ARTICLES)
    (kb / "demo" / "common_patterns.txt").write_text(C.PATTERNS)
    (kb / "regulation_index").write_text(json.dumps({"frameworks": [{"id": "demo", "name": "Demo", "version": "1.0", "region": "EU", "description": "first"}]}))
    doc = tmp_path / "a.txt"
    doc.write_text("1. Storage\n" + "All personal data of a user is retained indefinitely by the system. " * 3)
    base = ["--knowledge-base", str(kb)]
    assert main([*base, "frameworks"], spark) == 0 and "demo: Demo 1.0 (EU) - first; files: articles.txt, common_patterns.txt" in capsys.readouterr().out
    assert main([*base, "models"], spark) == 0 and "small: llama3:8b, batch size 4" in capsys.readouterr().out
    assert main([*base, "analyze", str(doc), "--framework", "demo", "--export", str(tmp_path / "out")], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["document"] == "a.txt" and report["findings"][0]["section"] == "1. Storage" and report["analysis_type"] == "progressive"
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert main([*base, "analyze", str(doc), "--framework", "demo", "--export-files", str(tmp_path / "files"), "--date", "now"], spark) == 0 and capsys.readouterr()
    assert [p.name for p in (tmp_path / "files").iterdir()] == ["a_report.txt"] and "Document: a.txt\n" in (tmp_path / "files" / "a_report.txt").read_text()
    assert main([*base, "analyze", str(doc), "--framework", "none"], spark) == 1 and "available: demo" in capsys.readouterr().err


def test_few_large_files_are_spread(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", "All personal data of a user is retained. " * 50) for i in range(60)], "doc_id string, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    spread = lambda: "RepartitionBy" in readers.spread(docs)._jdf.queryExecution().analyzed().toString() or "Repartition " in readers.spread(docs)._jdf.queryExecution().analyzed().toString()
    assert not spread()  # a small table isn't worth a shuffle
    monkeypatch.setattr(readers, "SPREAD_BYTES", 100)
    assert spread() and "Repartition" in audit.routed_chunks(docs, rules(spark))._jdf.queryExecution().analyzed().toString()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        assert not spread()  # the scan gives partitions enough
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_progressive_from_the_chunks(spark):
    from lexaudit.operators import findings, reports

    docs = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "doc_id int, document_type string").withColumns({"potential_data_mentions": C.F.array().cast("array<string>"), "compliance_indicators": C.F.array().cast("array<string>")})
    chunk = "doc_id int, chunk_index int, position string, text string, should_analyze boolean"
    chunks = spark.createDataFrame([(1, 0, "S", "t", True), (1, 1, "S", "t", None), (2, 0, "S", "t", None)], chunk)
    raw = spark.createDataFrame([], "doc_id int, chunk_index int, kind string, ord int, description string, regulation string, confidence string, citation string, explanation string, section string, should_analyze boolean")
    shown = lambda **o: {r.doc_id for r in reports.report_lines(docs, chunks, raw, findings.deduplicate(raw), "demo", "now", **o).where("line like 'Analysis Method: Progressive%'").collect()}
    assert shown() == {1} and shown(progressive=True) == {1, 2, 3} and shown(progressive=False) == set()


def test_report_tasks_grow_and_number_rows(spark, monkeypatch):
    from lexaudit.operators import documents, findings, reports

    raw = C.build(spark, DATA, C.REPORT_FINDINGS)
    docs = documents.with_metadata(C.build(spark, DATA, C.AUDIT_DOCS))
    lines = lambda: reports.report_lines(docs, C.build(spark, DATA, C.REPORT_CHUNKS), raw, findings.deduplicate(raw), "demo", "now")
    one = lines()
    monkeypatch.setattr(reports, "TASK_BYTES", 3_000)
    many = lines()
    assert many.rdd.getNumPartitions() > one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert many.exceptAll(one).isEmpty() and many.count() == one.select("doc_id", "line_no").distinct().count()
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.index("posexplode") < plan.index("Window")  # lines become rows after their rows are sorted and numbered


def test_marks_in_texts(spark):
    from lexaudit.operators import answers, documents

    text = "1. First\nbody \ufdd0 with \ufdd1 marks\n2. Second\nmore"
    got = [(r.title, r.text) for r in documents.sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("section_ord").collect()]
    assert [t for t, _ in got] == ["1. First", "2. Second"] and "body \ufffd with \ufffd marks" in got[0][1]
    rows = spark.createDataFrame([(1, 0, "S", True, "COMPLIANCE ISSUES:\n1. a long \ufdd0 item here\n2. another long item")], "doc_id int, chunk_index int, position string, should_analyze boolean, response string")
    assert [r.description for r in answers.parse_answers(rows).orderBy("ord").collect()][0].startswith("a long \ufffd item here")


def test_rollups_shuffle_once(spark):
    from lexaudit.operators import findings

    rows = spark.createDataFrame([(1, "issue", "high", "A", True), (1, "issue", "Low", "A", False), (1, "point", "High", "B", True), (2, "issue", None, None, None)], "doc_id int, kind string, confidence string, regulation string, should_analyze boolean")
    rolled = findings.rollups(rows)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = {(r.doc_id, r["of"], r.kind, r.confidence, r.regulation): (r.n_findings, r.n_analyzed) for r in rolled.collect()}
    assert got[1, "document", None, None, None] == (3, 2) and got[1, "kind", "issue", None, None] == (2, 1) and got[1, "confidence", "issue", "HIGH", None] == (1, 1) and got[1, "regulation", "issue", None, "A"] == (2, 1)
    assert got[2, "regulation", "issue", None, None] == (1, 0) and len(got) == 12


def test_indicators_in_any_case(spark):
    from lexaudit.operators import violations

    rows = spark.createDataFrame([(1, 0, "Users MUST agree, and agree again"), (2, 0, ""), (3, 0, None), (4, 0, "no")], "doc_id int, chunk_index int, text string")
    wanted = spark.createDataFrame([(0, i, "p", "", x, []) for i, x in enumerate(("must AGREE", "agree", "a", "none"))], "pattern_ord int, indicator_ord int, pattern string, description string, indicator string, related_refs array<string>")
    found = sorted((r.doc_id, r.indicator, r.context) for r in violations.scan_indicators(rows, wanted).collect())
    assert [x[1] for x in found] == ["a", "agree", "must AGREE"] and {x[2] for x in found} == {"Users MUST agree, and agree again"}


def test_files_of_each_kind(spark, tmp_path):
    """Text and PDF files together."""
    import pytest

    content = C.make_pdf(["first", "", "third"])
    (tmp_path / "a.PDF").write_bytes(content)
    (tmp_path / "b.md").write_text("text")
    got = {r.path.rsplit("/", 1)[1]: (r.n_bytes, r.text) for r in readers.read_files(spark, [str(tmp_path / "a.PDF"), str(tmp_path / "b.md")]).collect()}
    assert got == {"a.PDF": (len(content), "[Page 1] first\n\n[Page 3] third\n\n"), "b.md": (4, "text")}
    with pytest.raises(ValueError, match="c.doc"):
        readers.read_files(spark, ["b.md", "c.doc"])
