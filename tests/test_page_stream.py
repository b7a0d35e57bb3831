import datetime as dt

from pyspark.sql import functions as F

from lexaudit.operators import findings
from lexaudit.plans import audit
from lexaudit.plans import corpus as C
from lexaudit.sources import readers
from lexaudit.streaming import audit_stream, page_stream

SCHEMA = "doc_id string, page int, total int, text string, arrived timestamp"
START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, sink=None):
    """The stream over one file for each batch, in their order."""
    folder = tmp_path / "pages"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r[:4], START + dt.timedelta(minutes=r[4])) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"b{i}"))
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / f"b{i}").glob("*.parquet"))
        part.rename(folder / f"{i:03}.parquet")
        import os

        os.utime(folder / f"{i:03}.parquet", (1_000_000 + i, 1_000_000 + i))  # the source reads by time
    pages = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    docs = page_stream.page_documents(pages)
    if sink:
        return sink(docs)
    query = docs.writeStream.format("memory").queryName("whole").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return {r.doc_id: (r.text, r.n_pages, r.complete) for r in spark.table("whole").collect()}, spark.table("whole").count()


def test_pages_in_three_batches_late_and_twice(spark, tmp_path):
    batches = [
        [("a", 2, 3, "two", 0), ("b", 1, 1, "only", 0), ("a", 2, 3, "two again", 1), (None, 1, 1, "x", 0), ("c", 1, 2, "c one", 0)],
        [("a", 3, 3, "", 2), ("b", 1, 1, "late", 3)],
        [("a", 1, 3, "one", 4)],
        [("a", 1, 3, "after the end", 5), ("z", 1, 1, "tick", 60)],
        [("z", 1, 1, "tock", 61)],
        [("z", 1, 1, "tock", 62)],
    ]
    got, n = run(spark, tmp_path, batches)
    assert got["a"] == ("[Page 1] one\n\n[Page 2] two\n\n", 3, True) and got["b"] == ("[Page 1] only\n\n", 1, True)
    assert got["c"] == ("[Page 1] c one\n\n", 1, False)  # its second page never came
    assert set(got) == {"a", "b", "c", "z"} and n == 4


def test_stream_gives_the_findings_of_the_batch_audit(spark, tmp_path):
    rules = audit.Framework("demo", patterns=readers.parse_patterns(C.literal(spark, framework="demo", text=C.PATTERNS)))
    texts = ["1. Storage\n" + "All personal data of a user is retained indefinitely by the system. " * 3, "", "2. Consent\n" + "Users must agree before data is processed, and consent cannot be withdrawn. " * 3]
    rows = [(f"d{i}", p + 1, 3, t, 0) for i in range(6) for p, t in enumerate(texts)]
    batches = [[r for r in rows if r[1] == p] + [r for r in rows if r[1] == 3 and p == 1][:2] for p in (3, 1, 2)]  # pages out of order, some twice

    def sink(docs):
        query = audit_stream.audit_stream(docs.select("doc_id", "text"), rules, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    got = run(spark, tmp_path, batches, sink)
    whole = readers.join_pages(spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id string, page int, text string"))
    want = findings.deduplicate(audit.rule_audit(whole, rules)[1])
    columns = ["doc_id", "kind", "key", "description", "regulation", "n_merged"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect())) and want.where(F.col("doc_id") == "d0").count() > 1
