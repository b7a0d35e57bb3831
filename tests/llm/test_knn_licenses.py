from itertools import zip_longest

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import knn
from lexaudit.llm.knn import KDTree, top_k
from lexaudit.llm.licenses import _BSD, _BSD_CLAUSES, _BSD_REST, _BSD_THIRD, _MIT, _MIT_REST, TEMPLATES, anchors_of, bigrams_of, hints_of, scan_licenses


def brute(rows, is_query, k):
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault(i, set()).add(tuple(int(np.floor(1024 * float(x))) for x in v))
    out = set()
    for q in whole:
        if is_query(q):
            best = {}
            for a in whole[q]:
                for i, vs in whole.items():
                    for b in vs if i != q else ():
                        if len(a) == len(b):
                            best[i] = max(best.get(i, -(10**18)), sum(x * y for x, y in zip(a, b)))
            out |= {(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [40, 16_384])
def test_top_k_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(knn, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(knn, "PILOT_ROWS", 120)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 6).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]  # ties
    rows += [(5, rows[5][1]), (7, [1.0] * 6), (None, [1.0] * 6), (2000, None), (2001, []), (2002, [1.0, None] * 3), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2010, [1.0, 2.0]), (2020, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, dim int, shard int")
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda i: i % 10 == 0, 5)
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("pilot_rows", [1, 4_000])
def test_an_id_with_more_than_k_vectors(spark, monkeypatch, pilot_rows):
    """Its rows neither fill the list nor raise the floor, in a shard or in the pilot."""
    monkeypatch.setattr(knn, "PILOT_ROWS", pilot_rows)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 4).round(1).tolist()) for i in range(200)]
    rows += [(7, [5.0 + j, 5.0, 5.0, 5.0 + j % 3]) for j in range(300)] + [(20, [float(-j), 1.0, 2.0, 3.0]) for j in range(100)]
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda i: i % 10 == 0, 5)


def clustered(count, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dim))
    return (3 * centres[rng.integers(12, size=count)] + rng.normal(0, 0.05, (count, dim))).round(3)


def test_clustered_vectors_are_pruned(spark, monkeypatch):
    """Cells are cells of the global split, queries reach few of them, and the result is that of brute force."""
    monkeypatch.setattr(knn, "SHARD_ROWS", 60)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(1_200, 8, 6))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    inner = knn.Layout.reached
    layout = {}
    monkeypatch.setattr(knn.Layout, "__init__", lambda self, found, old=knn.Layout.__init__: (old(self, found), layout.setdefault("it", self))[0])
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, 5).collect()]
    assert set(got) == brute(rows, lambda i: i % 20 == 0, 5) and len(got) == len(set(got))
    plan = layout["it"]
    queries = np.floor(1024 * np.array([v for i, v in rows if i % 20 == 0])).astype(np.int64)
    kth = {q: s for q, r, _, s in got if r == 5}
    dealt = inner(plan, 8, queries, np.array([kth[i] for i, _ in rows if i % 20 == 0], dtype=float))
    assert plan.shards >= 12 and dealt.mean() < 0.5


def test_leaves_opened():
    """Of clustered vectors a tree opens few leaves."""
    vectors = np.floor(1024 * clustered(8_000, 16, 7)).astype(np.int64)
    tree = KDTree(np.arange(8_000), vectors)
    tree.search(np.arange(50), vectors[:50], np.full(50, -np.inf), 10)
    assert tree.opened < 0.35 * 50 * sum(c is None for c in tree.children)


def test_boxes_are_tight_and_large_values_exact():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-(2**29), 2**29, (500, 4))
    tree = KDTree(np.arange(500), vectors)
    for (a, b), low, high in zip(tree.parts, tree.low, tree.high):
        assert (tree.vectors[a:b].min(axis=0) == low).all() and (tree.vectors[a:b].max(axis=0) == high).all()
    (ids, scores), = tree.search(np.array([-1]), vectors[:1], np.array([-np.inf]), 3)
    exact = [sum(int(x) * int(y) for x, y in zip(v, vectors[0])) for v in vectors]
    assert scores.tolist() == sorted(exact, reverse=True)[:3]


def test_licenses(spark):
    mit = next(t for n, t in TEMPLATES if n == "mit" and t.startswith("Permission"))
    rows = [
        (1, None), (2, ""), (3, "no such line here"), (4, "words\nReleased under the MIT License.\nAll rights reserved"),
        (5, mit.replace(", ", ",\n")), (6, "x\n\n" + mit.upper() + "\n\ny"), (7, "released under mit license"), (8, "all " * 5_000), (8, "all " * 5_000), (None, "licensed under cc by nc 4 0"),
    ]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, license string, dice int")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert [got[i].n_matches for i in (1, 2, 3, 8)] == [0] * 4 and got[3].license is None and got[3].licenses == ""
    assert (got[4].n_matches, got[4].license, got[4].licenses) == (2, "mit", "all-rights-reserved,mit")
    assert got[5].license == got[6].license == "mit" and got[5].dice == 1.0
    assert got[7].n_matches == 0 and got[None].license == "cc-by-nc-4.0"
    assert scan_licenses(docs.limit(0)).count() == 0


def test_anchors_and_hints_are_needed_for_a_match():
    hints = hints_of([text for _, text in TEMPLATES])
    assert len(hints) < 80
    for _, text in TEMPLATES:
        for needed in (anchors_of(text), hints):
            free = [b for b in bigrams_of(text) if not needed & set(b.split())]
            assert 2 * len(free) / (len(free) + len(bigrams_of(text))) < 0.8


def test_licenses_as_they_are_written(spark):
    """Whole licences in comments, with other words around them, and notices within a line."""
    comment = lambda text, width=9: "\n".join(f" * {' '.join(w)}" for w in zip_longest(*[iter(text.split())] * width, fillvalue=""))
    parts = {"mit": [_MIT, _MIT_REST], "bsd-2-clause": [_BSD, _BSD_CLAUSES, _BSD_REST], "bsd-3-clause": [_BSD, _BSD_CLAUSES, _BSD_THIRD, _BSD_REST]}
    texts = {name: "/*\n * Copyright (c) 2020 Foo, Inc.\n *\n" + "\n *\n".join(map(comment, own)) + "\n */\nint main() { return 0; }\n" + "int x;\n" * 50 for name, own in parts.items()}
    texts["mit-paragraph"] = "a b c " * 40 + _MIT + " d e f" * 40
    texts["rights"] = "Copyright 2020 Foo Inc. All rights reserved. Some more prose follows on this line."
    texts["gpl-3.0"] = "# foo.py\n#\n# This program is free software: you can redistribute it and/or modify it under the\n# terms of the GNU General Public License as published by the Free Software\n# Foundation, either version 3 of the License, or (at your option) any later version.\n#\nimport os"
    texts["repeated"] = "noninfringement software " * 3_000
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for name in ("mit", "bsd-2-clause", "bsd-3-clause", "gpl-3.0"):
        assert got[name].license == name and got[name].dice > 0.9, name
    assert got["mit-paragraph"].license == "mit" and got["mit-paragraph"].dice > 0.95 and got["rights"].license == "all-rights-reserved" and got["rights"].dice == 1.0
    assert got["repeated"].n_matches == 0
