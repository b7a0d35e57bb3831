import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from lexaudit.llm import quality, toxicity
from lexaudit.llm.quality import QualityModel, describe, score_quality
from lexaudit.llm.queries import op2_toxicity, op3_quality_classifier
from lexaudit.llm.toxicity import BUCKET_BITS, DECAY, LENGTH, SPAN, WINDOWS, Sentences, ToxicityModel, embed, fit_toxicity, kernel, place_scores, score_toxicity

DATA = "/root/testdata/sf0.01"


def held_out(spark, scores, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", label)
    return [(r[label], r.score, r.predicted) for r in scores.where("held_out").join(labels, "doc_id").collect()]


def test_toxicity_held_out(spark):
    rows = held_out(spark, op2_toxicity(spark, DATA), "toxic")
    toxic, clean = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    assert sum(r[2] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r[2] for r in clean) <= 0.02 * len(clean)


def test_quality_held_out(spark):
    rows = held_out(spark, op3_quality_classifier(spark, DATA), "quality")
    assert sum(r[2] == r[0] for r in rows) >= 0.95 * len(rows)


def subsequences(window):
    """(subsequence, weight) of every occurrence, straight from the definition."""
    for at in combinations(range(len(window)), LENGTH):
        if at[-1] - at[0] < SPAN:
            yield "".join(window[i] for i in at), DECAY ** (at[-1] - at[0] + 1)


def brute_kernel(a, b):
    norm = lambda size: np.sqrt(sum(w * w for _, w in subsequences("x" * size)))
    return sum(v * w for u, v in subsequences(a) for x, w in subsequences(b) if u == x) / norm(len(a)) / norm(len(b))


def embedded(windows):
    padded = np.zeros((len(windows), WINDOWS[-1]), dtype=np.uint32)
    for i, w in enumerate(windows):
        padded[i, : len(w)] = [ord(c) for c in w]
    return embed(padded, np.array([len(w) for w in windows]))


def test_kernel_equals_brute_force():
    windows = [" idiot", " idiiot l", " id iot a ", "stupid", "a a a a a", " été là s", " worthless "]
    windows = [w.ljust(next(s for s in WINDOWS if s >= len(w)), "z") for w in windows]
    got = kernel(embedded(windows), embedded(windows))
    for i, a in enumerate(windows):
        for j, b in enumerate(windows):
            assert abs(got[i, j] - brute_kernel(a, b)) < 1e-9


def test_collapsed_decisions_equal_a_loop_over_windows():
    rng = np.random.default_rng(5)
    text = "You id iot, i.d.i.o.t! Été à Paris.\nx\n" + " ".join("".join(rng.choice(list("abio"), rng.integers(1, 9))) for _ in range(60)) + ". End"
    block = Sentences(["", text, "!!", "tail of it"])
    landmarks, alpha = embedded([" idiot", " paris en", "abioabioabio"]), np.array([0.7, -0.4, 1.1])
    table = np.bincount(landmarks[0].ravel(), weights=(landmarks[1] * alpha[:, None]).ravel(), minlength=1 << BUCKET_BITS)
    sentences = ["".join(map(chr, block.codes[a:b])) for a, b in zip(block.start, block.stop)]
    assert sentences[:4] == [" you id iot idiot ", " été à paris ", " x ", sentences[3]] and sentences[-2:] == [" end ", " tail of it "] and set(block.text) == {1, 3}
    got = place_scores(block, table)
    for a, sentence in zip(block.start, sentences):
        for k in range(len(sentence)):
            cut = sentence[k : k + WINDOWS[-1]]
            padded = np.zeros((1, WINDOWS[-1]), dtype=np.uint32)
            padded[0, : len(cut)] = [ord(c) for c in cut]
            want = max(float((kernel(embed(padded, np.array([size])), landmarks) @ alpha)[0]) for size in WINDOWS)
            assert abs(got[a + k] - want) < 1e-9


def test_pieces_of_a_long_text(monkeypatch):
    texts = ["one line of words. another\n" * 50, "word " * 300, "x" * 3_000, "", "\n\n"]
    monkeypatch.setattr(toxicity, "_PIECE", 100)
    for t in texts:
        pieces = list(toxicity._pieces(t))
        assert "".join(pieces) == t and all(len(p) <= 100 for p in pieces) and all(p[-1] in "\n x" for p in pieces[:-1])


def toy():
    rng = random.Random(1)
    syllables = ["la", "mo", "ri", "te", "nu", "sa", "ko"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(400):
        text = [word() for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "stupid", "worthless"]))
        texts.append(" ".join(text))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_gapped_and_inserted_insults():
    model = ToxicityModel.train(*toy())
    for text in ("you idiot idiot", "you i d i o t and st-upid", "a worrthless la mo idiiot", "WORTHLESS!! IDIOT$$$", "la mo wort hless. you id iot ri"):
        assert model.score(text) >= 0.7, text
    for text in ("la mori te nusa", "", None, "!!! 123", "mo " * 30_000):
        assert model.score(text) < 0.7
    assert model.score("la mo. " * 300_000 + "you idiot idiot") > model.score("la mo. " * 300_000)
    assert np.allclose(model.scores(["you idiot", "la", None]), [model.score(t) for t in ("you idiot", "la", None)])


def test_toxicity_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "idiot idiot"), (4, "idiot" * 30_000), (4, "idiot" * 30_000)]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in rows], "doc_id long, text string, score double")
    model = ToxicityModel.train(*toy())
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    assert set(got) == {1, 2, None, 4} and all(0 <= s <= 1 for s in got.values()) and got[None] > 0.7 and got[1] < 0.7
    assert {r.score for r in score_toxicity(docs, ToxicityModel.train(["a"], [0])).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), ToxicityModel.train([], [])).count() == 0
    texts, labels = toy()
    learnt = fit_toxicity(spark.createDataFrame(list(enumerate([*texts, None])), "doc_id int, text string"), spark.createDataFrame([*enumerate(labels), (400, 1), (3, None)], "doc_id int, toxic int"), F.lit(True))
    assert learnt.score("you idiot idiot") >= 0.7


def test_quality_edge_cases(spark):
    good, bad = b"A plain sentence of several words stands here. " * 9, b"A### plain$$$ sentence&&& of%%% words!! " * 9
    model = QualityModel.train([good, bad] * 40, [1, 0] * 40)
    rows = [(1, None), (2, ""), (None, good.decode()), (4, bad.decode() * 500), (4, bad.decode() * 500)]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in rows], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    assert got[None] > 0.7 and got[4] < 0.3 and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]
    assert score_quality(docs, QualityModel.train([], [])).first().score == 0.5
    assert score_quality(docs.limit(0), model).count() == 0


def test_passages_of_a_block_equal_those_of_single_texts():
    texts = [b"one two two\nTHREE | 4!", None, b"x " * 200, "Été ÉTÉ".encode()]
    block, sizes = describe(texts)
    alone = [describe([t]) for t in texts]
    assert sizes.tolist() == [int(n[0]) for _, n in alone] == [1, 1, 4, 1]
    assert np.allclose(block, np.concatenate([x for x, _ in alone]))


def test_a_long_text_in_pieces(monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(1_000)).encode(), b"a" * 700 + b" b\n| c! " * 300, b"", None, b"  x\n" * 400, b"y" * 900]
    want, sizes = describe(texts)
    monkeypatch.setattr(quality, "_PIECE", 200)
    assert all(b"".join(quality._pieces(t or b"")) == (t or b"") for t in texts) and len(list(quality._pieces(texts[0]))) > 5
    got, pieces = describe(texts)
    assert pieces.tolist() == sizes.tolist() and np.allclose(got, want)


def test_quality_equals_a_loop_over_passages():
    rng = np.random.default_rng(8)
    words = ["plain", "words", "Stand", "here,", "###", "|", "9", "été"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 400))).encode() for _ in range(60)]
    model = QualityModel.train(texts, [i % 2 for i in range(60)])
    p = model.weights
    for text, score in zip(texts[:20], model.score(texts[:20])):
        x, _ = describe([text])
        h = [np.tanh(np.clip((row - model.mean) / model.scale, -8, 8) @ p["W"] + p["b"]) for row in x]
        gate = [np.exp((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"]) for v in h]
        z = sum(g * v for g, v in zip(gate, h)) / sum(gate)
        assert abs(score - 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))) < 1e-5


def test_training_rows_are_bounded_where_an_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 60)
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 50)
    seen = {}
    monkeypatch.setattr(ToxicityModel, "train", classmethod(lambda cls, texts, labels: seen.update(toxic=labels) or cls(np.zeros(1 << BUCKET_BITS), 0.0, None)))
    monkeypatch.setattr(QualityModel, "train_described", classmethod(lambda cls, x, bags, labels: seen.update(quality=labels)))
    docs = spark.range(6_000).selectExpr("if(id < 5000, 1, id) AS doc_id", "concat('some text ', id) AS text")
    labels = spark.range(0, 60).selectExpr("if(id = 0, 1, 5000 + id) AS doc_id", "cast((id + 1) % 2 AS int) AS toxic", "cast(id % 2 AS int) AS quality")
    fit_toxicity(docs, labels, F.lit(True))
    assert sum(seen["toxic"]) == 40 and seen["toxic"].count(0) == 30
    quality.fit_quality(docs, labels, F.lit(True))
    assert len(seen["quality"]) == 50


def test_any_part_of_a_long_training_sentence_can_be_drawn():
    import pyarrow as pa

    texts = [" ".join(f"word{i}x{k}" for i in range(900)) + ". Short one." for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([1] * 60), pa.array(texts)], names=["doc_id", "label", "text"])
    (out,) = toxicity._sample_sentences(iter([batch]))
    drawn = [t.split("\n") for t in out["text"].to_pylist()]
    assert all(short == "Short one." and long in text and len(long) <= toxicity.MAX_SENTENCE for (long, short), text in zip(drawn, texts))
    places = [text.index(long) for (long, _), text in zip(drawn, texts)]
    assert min(places) < 3_000 and max(places) > 5_000 and len(set(places)) > 10
