import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import language_id
from lexaudit.llm.language_id import SIZES, LanguageModel, fit_language_model, fold, grams, identify_languages
from lexaudit.llm.queries import op1_language_id
from lexaudit.llm.shingles import mix

from ..oracle import DATA


def test_held_out_accuracy(spark):
    found = op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.95 and 0 <= held[1] <= held[2] <= 1


def test_masks_hold_every_member_and_few_others():
    """A Bloom filter has no false negatives; false positives are near the corrected rate."""
    rng = np.random.default_rng(1)
    members = {f"l{k:02d}": rng.integers(0, 1 << 62, 1200, dtype=np.uint64) for k in range(70)}
    model = LanguageModel.build(members)
    assert model.table.shape[1] == 2
    from lexaudit.llm.language_id import _slots

    def mask(values, l):
        out = np.ones(len(values), dtype=bool)
        for slot in _slots(values):
            out &= ((model.table[slot, l // 64] >> np.uint64(l % 64)) & np.uint64(1)).astype(bool)
        return out

    for l, name in enumerate(sorted(members)):
        assert mask(members[name], l).all()
    others = rng.integers(0, 1 << 62, 200_000, dtype=np.uint64)
    assert abs(mask(others, 3).mean() - model.false_positive_rates()[3]) < 1e-3


def gathered(texts):
    """The hashes of every text and n-gram length in order, and the letters of each text."""
    out, letters = [[[] for _ in texts] for _ in SIZES], np.zeros(len(texts))
    for found, counts in grams(texts):
        letters += counts
        for k, (hashes, owner) in enumerate(found):
            for i in range(len(texts)):
                out[k][i] += hashes[owner == i].tolist()
    return out, letters


TEXTS = [b"Hello, World", b"", None, "Été à  Paris".encode(), b"123", "ΑΣ Σ!! 3ab".encode(), b"x" * 50, b" a b  c "]


def test_grams_of_a_block_equal_those_of_single_texts():
    block, letters = gathered(TEXTS)
    assert letters.tolist() == [10, 0, 0, 9, 0, 5, 50, 3]
    for i, t in enumerate(TEXTS):
        alone, _ = gathered([t])
        assert [x[i] for x in block] == [x[0] for x in alone]


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 16])
def test_grams_of_pieces(monkeypatch, piece):
    want = gathered(TEXTS)
    monkeypatch.setattr(language_id, "_PIECE", piece)
    got = gathered(TEXTS)
    assert got[0] == want[0] and got[1].tolist() == want[1].tolist()


def plain_grams(text, n):
    """N-grams from the definition."""
    text = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def test_predictions_equal_plain_sets():
    """Filters against sets of n-grams: the corrected rates are near the plain rates, and texts get the language of the sets."""
    rows = duckdb.sql(f"SELECT text, lang FROM '{DATA}/documents.parquet' WHERE lang IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    train, rest = rows[:500], rows[500:700]
    kept, members = {}, {}
    for lang in sorted({r[1] for r in train}):
        kept[lang], members[lang] = set(), []
        for k, n in enumerate(SIZES):
            top = [g for g, _ in sorted(Counter(g for t, l in train if l == lang for g in plain_grams(t, n)).items(), key=lambda x: (-x[1], x[0]))[:600]]
            kept[lang] |= set(top)
            # the hash of an n-gram is that of its only occurrence in a text that is it
            members[lang] += [h for g in top for h in gram_hashes(g, n)]
    model = LanguageModel.build({lang: np.array(h, dtype=np.uint64) for lang, h in members.items()})
    rates, _ = model.rates([t.encode() for t, _ in rest])
    same = 0
    for (text, _), own in zip(rest, rates):
        every = [g for n in SIZES for g in plain_grams(text, n)]
        plain = [sum(g in kept[lang] for g in every) / max(1, len(every)) for lang in model.languages]
        assert np.abs(own - plain).max() < 0.02
        same += model.languages[int(own.argmax())] == model.languages[int(np.argmax(plain))]
    assert same >= len(rest) - 1


def gram_hashes(gram, n):
    h = n
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    return mix(np.array([h], dtype=np.uint64)).tolist()


def test_edge_cases(spark):
    en, de = "the house of the rising sun and the sea " * 5, "der hund und die katze sitzen auf dem dach " * 5
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)] + [(None, en, "en"), (50, None, "en"), (51, "", None), (52, "123 !", "en"), (53, "x" * 200_000, None)]
    docs = spark.createDataFrame([(*r, 0.5, "old") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = fit_language_model(docs, fold(F.col("doc_id"), 5) != 0)
    assert model.languages == ["de", "en"]
    out = identify_languages(docs.drop("lang"), model)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[None][0] == "en"
    assert got[50] == got[51] == got[52] == ("und", 0.0)
    assert got[53][0] in ("de", "en")
    assert identify_languages(docs.limit(0), model).count() == 0
    empty = fit_language_model(docs, F.lit(False))
    assert {r.lang_pred for r in identify_languages(docs, empty).collect()} == {"und"}
