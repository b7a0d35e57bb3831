import random
import re
from datetime import date
from decimal import Decimal

import pytest

from lexaudit.llm import decontaminate
from lexaudit.llm.decontaminate import drop_contaminated, find_items


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return set(zip(*[words[k:] for k in range(n)])) if len(words) >= n else ({tuple(words)} if words else set())


def planted(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 7, 12, 30, 70, 200])))) for i in range(60)]
    docs = []
    for d in range(200):
        text = [rng.choice(words) for _ in range(rng.choice([0, 20, 300, 3000]))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                passage[rng.randrange(len(passage))] = rng.choice(words)
            at = rng.randint(0, len(text))
            half = rng.choice([0, len(passage) // 2])
            text[at:at] = passage[half:]
            text[0:0] = passage[:half]
        docs.append((d, " ".join(text)))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = planted(4)
    want = set()
    for d, text in docs:
        own = shingles(text)
        for i, item in items:
            s = shingles(item)
            if s and 100 * len(s & own) >= 80 * len(s):
                want.add((d, i, len(s), len(s & own)))
    found = find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in found} == want and len(found) == len(want) > 40


def test_blocks_of_items(spark, monkeypatch):
    docs, items = planted(5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, find_items(d, i).collect()))
    kept = drop_contaminated(d, i).count()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert sorted(map(tuple, find_items(d, i).collect())) == whole
    assert drop_contaminated(d, i).count() == kept == len(docs) - len({r[0] for r in whole})


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b c d e f", 5), (4, "A  b\nC d e F", 5), (4, "A  b\nC d e F", 5), (5, "a b", 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f"), (None, "a b"), (5, "a b c d e f")], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.containment) for r in find_items(docs, items).collect()))
    assert got == [(0, 3, 1.0), (0, 5, 1.0), (4, 3, 1.0), (4, 3, 1.0), (4, 5, 1.0), (4, 5, 1.0), (5, 0, 1.0)]
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert find_items(docs, items.limit(0)).count() == 0 and find_items(docs.limit(0), items).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == docs.count()


@pytest.mark.parametrize("kind,ids", [("int", [1, 2, None]), ("string", ["a", "b", None]), ("decimal(6,2)", [Decimal("1.50"), Decimal("-2.00"), None]), ("smallint", [1, 2, None]), ("date", [date(2020, 1, 1), date(1960, 1, 1), None])])
def test_ids_of_any_type(spark, kind, ids):
    texts = ["a b c d e f", "g h i j k l", "m n o p q r"]
    docs = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")
    items = spark.createDataFrame(list(zip(ids, texts)), f"item_id {kind}, text string")
    found = find_items(docs, items)
    assert found.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted(((i, i) for i in ids), key=str)
