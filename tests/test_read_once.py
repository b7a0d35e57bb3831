"""Costly steps are computed once for each row, and tasks grow in number with their table."""

from pyspark.sql import functions as F

from lexaudit.operators import documents, judges
from lexaudit.plans import corpus
from lexaudit.plans.queries import QUERIES
from lexaudit.sources import readers

from .oracle import DATA

MARKING = "regexp_replace(translate("


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_judge_reads_its_input_once(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("s").alias("position"), F.when(F.col("id") % 3 < 2, F.col("id") % 3 == 0).alias("should_analyze"), F.concat(F.lit("p"), "id").alias("prompt"))

    def answer(texts):
        if not all(t.startswith("p") and int(t[1:]) % 3 == 0 for t in texts) or "p30" in texts:
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    judged = judges.judge(rows, answer)
    assert plan(judged).count("Range") == 1
    found = {r.doc_id: (r.should_analyze, r.response, r.error) for r in judged.collect()}
    assert found == {i: (True, "", "RuntimeError: down") if i == 30 else (True, f"P{i}", None) if i % 3 == 0 else (False, "", None) for i in range(100)}


def test_large_ids_beside_null_ones_stay_exact(spark):
    rows = spark.createDataFrame([(2**60 + 1, 0, "s", True, "p"), (None, 0, "s", True, "q")], "doc_id long, chunk_index int, position string, should_analyze boolean, prompt string").coalesce(1)
    assert {r.doc_id for r in judges.judge(rows, lambda texts: texts).collect()} == {2**60 + 1, None}


def test_a_text_is_marked_once(spark):
    docs = spark.createDataFrame([(1, "1. One\na\n2. Two\nb"), (2, "none"), (3, "intro\nONE TWO\nc")], "doc_id int, text string")
    assert plan(documents.sections(docs)).count(MARKING) == 1


def test_queries_split_documents_once(spark):
    assert plan(QUERIES["skip_union"](spark, DATA)).count(MARKING) == 1
    for name in ("canned_judge", "prompt_build"):  # what reads chunks several times reads a table of them
        assert "DATA USAGE" not in plan(QUERIES[name](spark, DATA)), name


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id AS c_custkey", "'n' AS c_name", "'m' AS c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(readers, "SPREAD_BYTES", 100)
    cores = spark.sparkContext.defaultParallelism
    parts = {}
    for task_bytes in (1_000_000, 1_000):
        monkeypatch.setitem(corpus.TASK_BYTES, "customer", task_bytes)
        parts[task_bytes] = corpus.build(spark, str(tmp_path), corpus.AUDIT_DOCS).rdd.getNumPartitions()
    assert parts[1_000_000] == cores and parts[1_000] > 4 * cores


def test_answers_are_parsed_once_for_pairs(spark):
    assert "from_json" not in plan(QUERIES["contradiction_pairs"](spark, DATA))
