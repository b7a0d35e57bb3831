import numpy as np
from pyspark.sql import functions as F

from lexaudit.operators import embedding, retrieval
from lexaudit.operators.embedding import BUCKETS, _weighted, fit_latent, latent_embedding, word_buckets

DATA = "/root/testdata/sf0.01"


def documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars between 300 and 3000").dropDuplicates(["text"]).orderBy("doc_id").limit(400)
    words = F.split("text", r"\s+")
    half = lambda k: F.array_join(F.filter(words, lambda w, i: i % 2 == k), " ")
    return rows.select("doc_id", half(0).alias("text"), half(1).alias("asked"))


def test_subspace_equals_a_whole_decomposition(spark):
    rows = documents(spark)
    model = fit_latent(rows, dimensions=8)
    places = [np.array(r.p) for r in rows.select(word_buckets(F.col("text")).alias("p")).collect()]
    x = _weighted(np.concatenate(places), np.array([len(p) for p in places]), model.idf)
    values = np.linalg.eigvalsh(x @ x.T)[::-1][:8]
    kept = ((x @ model.projection) ** 2).sum(axis=0)
    assert kept.sum() >= 0.98 * values.sum() and np.allclose(model.projection.T @ model.projection, np.eye(8), atol=1e-2)


def test_the_model_does_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.createDataFrame(documents(spark).limit(120).collect())
    one, other = fit_latent(rows.repartition(1), dimensions=8), fit_latent(rows.repartition(7, "doc_id"), dimensions=8)
    assert (one.idf == other.idf).all() and (one.projection == other.projection).all()


def test_retrieval_beats_hashed_words(spark):
    """Every second word of a text asks for the text of the other words."""
    rows = documents(spark)

    def found(embed):
        articles = rows.select(F.col("doc_id").alias("art_ord"), embed(F.col("text")).alias("vector"))
        hits = retrieval.nearest(rows.select("doc_id", embed(F.col("asked")).alias("vector")), articles, ["doc_id"], 5)
        return hits.where("doc_id = art_ord").count()

    latent, hashed = found(latent_embedding(fit_latent(rows))), found(retrieval.hashed_embedding())
    print("found by latent and hashed vectors", latent, hashed)
    assert latent > hashed


def test_empty_texts(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "c d e")], "doc_id int, text string")
    embed = latent_embedding(fit_latent(rows, dimensions=2))
    got = {r.doc_id: r.v for r in rows.select("doc_id", embed(F.col("text")).alias("v")).collect()}
    assert got[2] == got[3] == [0.0, 0.0] and abs(sum(x * x for x in got[1]) - 1) < 1e-3
    none = fit_latent(rows.limit(0), dimensions=2)
    assert none.projection.shape == (BUCKETS, 2)
    assert embedding.DIMENSIONS == 64
