import pytest
from pyspark.sql import functions as F

from lexaudit.sources.report_files import ReportWriter, Staged, file_names, write_files


def listed(folder):
    return {p.name: p.read_text() for p in folder.iterdir()}


def test_a_named_file_for_each_row(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}.txt", f"text {i} é\nline") for i in range(50)] + [("empty.txt", None)], "name string, text string").repartition(7)
    (tmp_path / "other.txt").write_text("stays")
    (tmp_path / "n1.txt").write_text("old")
    write_files(rows, str(tmp_path))
    want = {f"n{i}.txt": f"text {i} é\nline" for i in range(50)} | {"empty.txt": "", "other.txt": "stays"}
    assert listed(tmp_path) == want
    write_files(rows, "file://" + str(tmp_path))  # again: no duplicates
    assert listed(tmp_path) == want
    write_files(rows.limit(0), str(tmp_path))
    assert listed(tmp_path) == want


def test_nothing_is_left_by_a_job_that_fails(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    bad = spark.range(40).repartition(4).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="broken row"):
        write_files(bad, str(folder))
    assert listed(folder) == {}
    for names, message in ((["a", "a"], "two rows have the name a"), (["a/b"], "not a name"), ([".."], "not a name"), ([""], "not a name")):
        with pytest.raises(Exception, match=message):
            write_files(spark.createDataFrame([(n, "x") for n in names], "name string, text string").repartition(2), str(folder))
        assert listed(folder) == {}
    with pytest.raises(Exception, match="absolute path"):
        write_files(spark.createDataFrame([("a", "x")], "name string, text string"), "hdfs://host/out")


def test_attempts_that_spark_does_not_accept_leave_nothing(tmp_path):
    writer = ReportWriter(str(tmp_path))
    for attempt, text in (("0-1", "lost"), ("0-2", "kept")):
        (tmp_path / writer.staging.rsplit("/", 1)[1] / attempt).mkdir()
        (tmp_path / writer.staging.rsplit("/", 1)[1] / attempt / "a.txt").write_text(text)
    writer.commit([Staged(f"{writer.staging}/0-2", ["a.txt"]), None])
    assert listed(tmp_path) == {"a.txt": "kept"}


def test_names(spark):
    docs = spark.createDataFrame([(1, "x/a.txt"), (2, "y/a.md"), (3, "z/b c.PDF"), (4, None), (5, "q/.hidden")], "doc_id int, path string")
    names = {r.doc_id: r.name for r in file_names(docs, F.col("path")).collect()}
    assert names[3] == "b-c_report.txt" and names[1] != names[2] and names[1].startswith("a-") and names[4].startswith("-") and len(set(names.values())) == 5
    assert not any(n.startswith((".", "_")) for n in names.values())
