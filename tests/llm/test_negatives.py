import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import negatives
from lexaudit.llm.negatives import BallTree, mine_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, cell string"


def brute_force(rows, step=5):
    usable = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], [math.floor(256 * x) for x in r[1]])):
        usable.setdefault(i, ([math.floor(256 * x) for x in v], label))
    out = []
    for a, (q, own) in usable.items():
        if a % step:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, v)), i, label) for i, (v, label) in usable.items() if i != a and len(v) == len(q))
        for minus, p, label in [s for s in scores if s[2] == own][:5]:
            fit = [s for s in scores if s[2] != own and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:3]
            out += [(a, p, k + 1, i, -minus, -s) for k, (s, i, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, step=5):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in mine_negatives(df, F.col("vec_id") % step == 0).collect())


@pytest.mark.parametrize("pilot", [8, 8192])
def test_against_brute_force(spark, monkeypatch, pilot):
    monkeypatch.setattr(negatives, "PILOT_ROWS", pilot)
    monkeypatch.setattr(negatives, "SHARD_ROWS", 60)
    monkeypatch.setattr(negatives, "LEAST_SHARD_ROWS", 20)
    monkeypatch.setattr(negatives, "LEAF", 8)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in centres[i % 5]], rng.randrange(4)) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6, i % 3) for i in range(120)]  # a large group of equal vectors
    rows += [(2000 + i, [1.0, float(i)], i % 2) for i in range(20)]  # of another length
    rows += [(None, [0.1] * 6, 1), (3000, None, 1), (3005, [], 1), (3010, [0.1, None, 0.2, 0.1, 0.3, 0.1], 1), (3015, [float("nan")] * 6, 1), (3020, [float("inf")] * 6, 2), (3025, [0.2] * 6, None)]
    rows += [rows[0], rows[5], (10, [3.0] * 6, 1), (4000, [0.0] * 6, 0), (4001, [0.0] * 6, 1), (4002, [0.0] * 6, 0)]  # repeated rows, one id with two vectors, zeros
    want = brute_force(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_degenerate_tables(spark):
    assert mined(spark, [(5, None, 1)]) == []
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1)]) == []
    assert mined(spark, [(5, [-1.0], 1), (6, [1.0], 1), (7, [1.0], 2)]) == []
    assert mine_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_balls_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 300
    vectors = np.floor(centres[rng.integers(0, 12, 8000)] + rng.normal(size=(8000, 16)) * 10).astype(np.int64)
    labels = np.arange(8000) % 4
    tree = BallTree(np.arange(8000), labels, vectors)
    q = vectors[17]
    top = int(q @ q)
    low, high = np.array([top // 2]), np.array([top * 95 // 100])
    (ids, scores), = tree.search(17, labels[17], q, low, high, 3, False)
    inside = sorted((-int(v @ q), i) for i, v in enumerate(vectors) if labels[i] != labels[17] and top // 2 <= v @ q <= top * 95 // 100)[:3]
    assert [(-s, i) for i, s in zip(ids, scores)] == inside
    leaves = sum(not c for c in tree.children)
    assert tree.opened < 0.45 * leaves  # a quarter of them holds the query's own label
