import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from lexaudit.llm.decontaminate import drop_contaminated

from ..oracle import DATA
from .test_near_dup import brute_force

TABLE = f"{DATA}/documents.parquet"


def test_stages(spark):
    docs = spark.read.parquet(TABLE)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_redaction", "bpe_encoding"]
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        tables[name] = docs
        if name != names[-1]:
            assert docs.columns == spark.read.parquet(TABLE).columns
    before = {r.doc_id: r.text for r in spark.read.parquet(TABLE).collect()}
    identified = {r.doc_id: r.text for r in tables["language_id"].collect()}
    assert set(before) - set(identified) <= {i for i, t in before.items() if len(t or "") < 40}
    roots = brute_force(list(identified.items()), 5)
    assert {r.doc_id for r in tables["near_dedup"].collect()} == {i for i, (_, root) in roots.items() if i == root}
    clean = drop_contaminated(tables["near_dedup"], spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert {r.doc_id for r in tables["decontamination"].collect()} == {r.doc_id for r in clean.collect()}
    redacted = tables["secret_redaction"].collect()
    assert not [r for r in redacted if re.search(r"token = \"[0-9a-f]{40}", r.text)]
    assert all(r.n_chars == len(r.text) for r in redacted if "[SECRET]" in r.text)
    assert tables["bpe_encoding"].count() == len(redacted)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(TABLE)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    key = lambda df: sorted((r.doc_id, bytes(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DATA)) == key(docs)


def test_empty_and_odd_rows(spark, tmp_path):
    rows = [(None, "the house and the sea", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "the house and the sea", "en", "s", 1), (3, "the house and the sea", "en", "s", 1)]
    schema = spark.read.parquet(TABLE).schema
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == (3 if given else 0)


def test_many_languages_drop_no_clean_document(spark):
    """A dozen languages that share three words in ten."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    shared = [word() for _ in range(25)]
    own = {f"l{k:02d}": [word() for _ in range(55)] for k in range(12)}
    rows = [(100 * k + i, " ".join(rng.choice(shared if rng.random() < 0.3 else own[lang]) for _ in range(150)), lang, "s", 0) for k, lang in enumerate(own) for i in range(20)]
    noise = [(9000 + i, " ".join(word() for _ in range(150)), None, "s", 0) for i in range(5)]
    docs = spark.createDataFrame(rows + noise, spark.read.parquet(TABLE).schema)
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {r[0] for r in rows}


def test_long_text_and_clashing_columns(spark, tmp_path):
    words = "the house and the sea and a garden by the road "
    rows = [(1, words * 20_000, "en", "s", 1), (2, f'a letter about the garden and the sea, token = "{"0123456789abcdef" * 3}" ends here', "en", "s", 1), (3, words, "en", "s", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(TABLE).schema)
    extra = ("pipeline_lang", "Pipeline_Score", "doc", "body", "new", "spans", "row", "id", "kept", "label", "battery", "item_id", "ids_", "text_")
    given = docs.select("*", *(F.lit(c).alias(c) for c in extra))
    spark.createDataFrame([(1, "no such passage stands in any of these documents at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, str(tmp_path))
        if name != "bpe_encoding":
            assert given.columns == [*docs.columns, *extra]
            assert all(r[c] == c for r in given.collect() for c in extra)
    assert {r.doc_id for r in given.collect()} == {1, 2, 3}
