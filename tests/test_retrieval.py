import random

import pytest

from lexaudit.operators import retrieval


def brute_force(queries, articles, k):
    usable = lambda v: v is not None and None not in v
    out = []
    for key, v in queries:
        if usable(v):
            near = sorted((round(sum((x - y) ** 2 for x, y in zip(v, w)), 6), a) for a, w in articles if a is not None and usable(w) and len(w) == len(v))
            out += [(key, i + 1, a, d) for i, (d, a) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_articles", [7, 10_000])
@pytest.mark.parametrize("block_bytes", [1, 32_000_000])
def test_against_brute_force(spark, monkeypatch, block_articles, block_bytes):
    monkeypatch.setattr(retrieval, "BLOCK_ARTICLES", block_articles)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", block_bytes)
    rng = random.Random(11)
    vector = lambda n: [float(rng.randrange(3)) for _ in range(n)]
    queries = [(i, vector(rng.choice([3, 3, 3, 2]))) for i in range(40)] + [(100, None), (101, [1.0, None, 0.0]), (102, [1.0] * 9), (103, [])]
    articles = [(f"a{i:02}", vector(rng.choice([3, 3, 2]))) for i in range(30)] + [("b", None), ("c", [None, 1.0]), (None, [1.0, 1.0])]
    rng.shuffle(articles)
    got = retrieval.nearest(spark.createDataFrame(queries, "key int, vector array<float>").repartition(3), spark.createDataFrame(articles, "art_ord string, vector array<float>"), ["key"], 4)
    assert sorted((r.key, r["rank"], r.art_ord, r.distance) for r in got.collect()) == brute_force(queries, articles, 4)


def test_texts_of_articles(spark, monkeypatch):
    articles = spark.createDataFrame([(i, f"id {i}", "t", "x" * 50, ["data"]) for i in range(20)], "art_ord int, id string, title string, text string, related_concepts array<string>")
    hits = spark.createDataFrame([(1, 3), (1, 4), (2, 3)], "key int, art_ord int")
    want = {(1, "id 3"), (1, "id 4"), (2, "id 3")}
    assert {(r.key, r.id) for r in retrieval.with_articles(hits, articles).collect()} == want
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 10)
    joined = retrieval.with_articles(hits, articles)
    assert {(r.key, r.id) for r in joined.collect()} == want and "ResolvedHint" not in joined._jdf.queryExecution().toString()
