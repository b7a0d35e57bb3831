import random
import re

from pyspark.sql import functions as F

from lexaudit.llm import near_dup, shingles
from lexaudit.llm.components import connected_components
from lexaudit.llm.near_dup import near_duplicates
from lexaudit.llm.storage import Workspace


def sets_of(texts, n):
    out = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = set(zip(*[words[k:] for k in range(n)])) if len(words) >= n else ({tuple(words)} if words else set())
    return out


def brute_force(texts, n):
    sets = sets_of(texts, n)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=12, size=14):
    """Groups of copies edited more and more, so that links are partly indirect and partly just missing."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 200]))]
        for k in range(size):
            copy = list(base)
            for _ in range(int(len(base) * 0.012 * k)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((len(texts) * 7 % 1009, " ".join(copy)))
    return texts


def check(spark, texts, n):
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), n).collect()
    want = brute_force(texts, n)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_equals_brute_force(spark):
    check(spark, corpus(1), 2)
    check(spark, corpus(2), 5)


def test_blocks_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 8)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    check(spark, corpus(3, groups=2, size=60), 2)


def test_a_bucket_of_many_families(spark, monkeypatch):
    """Near copies of one text, many of them too far from the first: families of one bucket are connected block by block, and no link is lost."""
    monkeypatch.setattr(near_dup, "BUCKET_PAIRS", 2)
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", 50)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(300), rng.choice([2, 11, 11, 11])):
            copy[at] = f"own{k}x{at}"
        texts.append((k, " ".join(copy)))
    check(spark, texts, 5)


def test_families_of_a_block_are_connected_by_few_pairs():
    """200 rows of 40 families that all lie within the distance, and one that doesn't."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    sig = np.repeat(rng.integers(0, 1 << 16, (1, near_dup.POSITIONS)), 201, axis=0).astype("<u2")
    for row in sig[:200]:
        row[rng.permutation(near_dup.POSITIONS)[:15]] += 1
    sig[200] += 1
    rows = list(range(201)) * 2
    block = {"rep": rows, "family": [r % 40 if r < 200 else 200 for r in rows], "n": [100] * 402, "sig": [sig[r].tobytes() for r in rows], "probe": [i < 201 for i in range(402)]}
    links = near_dup._bridges(80)(pa.table(block)).to_pylist()
    assert len(links) == 39
    assert all(x["a"] % 40 == x["fa"] and x["b"] % 40 == x["fb"] and (sig[x["a"]] != sig[x["b"]]).sum() <= near_dup.MAX_DISTANCE for x in links)
    reached = {0}
    for _ in links:
        reached |= {f for x in links for f in (x["fa"], x["fb"]) if {x["fa"], x["fb"]} & reached}
    assert reached == set(range(40))


def test_edge_cases(spark):
    long = " ".join(f"x{i % 9000}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, long), (7, long + " y"), (8, "é à"), (9, "É à"), (None, "one"), (10, "a b"), (10, "a b")]
    rows = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in texts], "doc_id long, text string, id string, n int, sig int, rep int")
    got = near_duplicates(rows, 2).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(texts)
    assert [by_id[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(by_id[i].kept for i in (1, 2, 3))
    assert by_id[5].component_id == 4 and by_id[7].component_id == 6 and by_id[9].component_id == 9
    assert by_id[None].component_id is None and by_id[None].kept
    assert [r.kept for r in got if r.doc_id == 10] == [True, True]
    assert near_duplicates(rows.limit(0), 2).count() == 0


def test_an_id_with_different_texts(spark):
    """One node: each of its texts keeps its links, also those that the smallest id of a class shares with others."""
    words = lambda k: " ".join(f"v{k}w{i}" for i in range(60))
    rows = [(k, words(k)) for k in range(5, 25)] + [(k + 100, words(k) + " x") for k in range(5, 25)]
    rows += [(1, words(k)) for k in range(5, 15)] + [(1, None), (30, None), (30, words(24) + " y"), (40, words(40)), (40, words(41)), (41, words(41))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2).collect()
    want = {1: 1} | {k: 1 if k < 15 else k for k in range(5, 25)} | {k + 100: 1 if k < 15 else k for k in range(5, 25)} | {30: 24, 40: 40, 41: 40}
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_signature_distance_is_guaranteed():
    """Every pair within the distance shares a key."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, near_dup.POSITIONS).astype("<u2")
    other = base.copy()
    changed = rng.permutation(near_dup.POSITIONS)[: near_dup.MAX_DISTANCE]
    other[changed] += 1
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([base.tobytes(), other.tobytes()], pa.binary())], names=["rep", "sig"])
    keys = next(near_dup._keys(iter([batch])))["key"].to_numpy()
    half = len(keys) // 2
    assert set(keys[:half]) & set(keys[half:])


def test_components_of_a_long_path(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = connected_components(links, Workspace(spark, "test"), "path").collect()
    assert len(got) == 300 and {r.component for r in got} == {0}
    assert connected_components(links.limit(0), Workspace(spark, "test"), "none").count() == 0


def test_words_across_pieces(monkeypatch):
    texts = [b"one two  three\n", None, b"", b"a" * 50, b" x ", "Été à Paris".encode(), b"end"]
    want = shingles.word_hashes(texts)
    for piece in (1, 2, 3, 7, 20):
        monkeypatch.setattr(shingles, "_PIECE", piece)
        got = shingles.word_hashes(texts)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
