import random

import pytest

from lexaudit.operators import needles
from lexaudit.operators.needles import find_needles


def found(rows, wanted, **options):
    return sorted((r.id, r.needle, r.tag, r["at"]) for r in find_needles(rows, "text", wanted, "needle", **options).collect())


@pytest.mark.parametrize("few, block_chars", [(0, 1), (0, 60), (0, needles.BLOCK_CHARS), (1_000, 1)])
def test_against_brute_force(spark, monkeypatch, few, block_chars):
    monkeypatch.setattr(needles, "FEW", few)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcé🙂 ") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 60)), "x") for i in range(150)] + [(200, None, "x"), (201, "", "x"), (0, "aab", "again")]
    wanted = [(word(rng.choice([1, 1, 2, 3, 4])), k) for k in range(25)] + [("", 99), (None, 98), ("aa", 97), ("a", 96), ("a", 95)]
    rows = spark.createDataFrame(texts, "id int, text string, other string").repartition(3)
    got = found(rows, spark.createDataFrame(wanted, "needle string, tag int"), block_chars=block_chars)
    assert got == sorted((i, n, k, t.index(n) + 1) for i, t, _ in texts if t is not None for n, k in wanted if n is not None and n in t)


def test_many_needles_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(needles, "OUT_CHARS", 30_000_000)
    wanted = spark.range(100_000).selectExpr("concat('n', id, ';') AS needle", "cast(id AS int) AS tag")
    long = spark.range(1).selectExpr("7 AS id", "concat(repeat('n1x;n2 ', 3000000), 'n31337;n5;', repeat('é', 10)) AS text")
    rows = spark.createDataFrame([(1, "n1;n22;n333;n1;"), (2, "n100000;"), (3, "nothing")], "id int, text string").union(long)
    hits = find_needles(rows, "text", wanted, "needle").drop("text")
    assert "NestedLoop" not in hits._jdf.queryExecution().toString() and "Cartesian" not in hits._jdf.queryExecution().toString()
    assert sorted((r.id, r.tag, r["at"]) for r in hits.collect()) == [(1, 1, 1), (1, 22, 4), (1, 333, 8), (7, 5, 21_000_008), (7, 31337, 21_000_001)]


def test_no_needles_and_no_rows(spark):
    none = spark.createDataFrame([], "needle string, tag int")
    rows = spark.createDataFrame([(1, "a")], "id int, text string")
    assert found(rows, none) == [] and found(rows.limit(0), spark.createDataFrame([("a", 1)], "needle string, tag int")) == []
    assert find_needles(rows, "text", none, "needle").columns == ["id", "text", "at", "needle", "tag"]
