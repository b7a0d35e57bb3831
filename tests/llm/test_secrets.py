import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm.secrets import CLASSES, ENCODINGS, KINDS, MAX_BITS, MIN_TOKEN, MOST_COST, TESTS_MEAN, _scan, character_costs, redact_secrets, scan_secrets, span_text

#: Costs for tests of the evidence, and prose from which costs are learned.
COSTS = (268, 405, 574, 430, 522)
PROSE = "Plain words of an ordinary text, with its Capitals, some 12 digits and a dash-or two. "

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{list(KINDS)[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(7)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "abc", "abcdef", "é", "🙂", "\n", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ff", "-", "=", "token : ", "x" * 7]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_secrets(rows).select("doc_id", span_text("concat(assign, access, hex)").alias("s")).collect():
        assert r.s == base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_tokens = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(100)]
    words = ["donaudampfschifffahrtsgesellschaft", "a" * 40, "1234567890" * 4, "0123456789abcdef" * 3, "get_user_name_from_the_database_of_users", "internationalization-and-localization", "http/www/example/com/some/long/path/of/words"] * 20
    rows = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate([*random_tokens, *words, PROSE * 2_000])], "doc_id long, text string")
    found = {r.doc_id for r in scan_secrets(rows).collect() if r.random}
    assert len([i for i in found if i < 100]) >= 95
    assert not [i for i in found if i >= 100]


def test_long_random_tokens_are_found(spark):
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choices(letters + extra, k=n)) for extra in ("", "+/", "-_") for n in (1_000, 2_000, 5_000, 10_000) for _ in range(5)]
    rows = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate([*tokens, PROSE * 50_000])], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.random] for r in scan_secrets(rows).collect()}
    assert all(got[i] == [(2, 2 + len(t))] for i, t in enumerate(tokens))
    assert all(r.text == "x [SECRET] y" for r in redact_secrets(rows).collect() if got[r.doc_id])


def evidence(token):
    """Bits of one token from the definition, test by test."""
    alphabet = next(x for _, p, x in ENCODINGS if re.search(p, token))
    a, n = len(alphabet), len(token)
    cost = sum(next(k for x, k in zip(CLASSES, COSTS) if c in x) for c in token)
    y = [2 * alphabet.index(c) + 1 - a for c in token]
    x2 = sum((token.count(c) - n / a) ** 2 / (n / a) for c in alphabet)
    chi = ((x2 / (a - 1)) ** (1 / 3) - (1 - 2 / (9 * (a - 1)))) / math.sqrt(2 / (9 * (a - 1)))
    runs = 1 + sum((u > 0) != (v > 0) for u, v in zip(y, y[1:]))
    even = abs(2 * runs - n - 1) / math.sqrt(n - 1)
    serial = abs(sum(u * v for u, v in zip(y, y[1:]))) / sum(u * u for u in y) * n / math.sqrt(n - 1)
    total = cost - n * round(64 * math.log2(a)) - round(64 * math.log2(TESTS_MEAN * len(ENCODINGS)))
    for z in (abs(chi), even, serial):
        p = 2 / (1 + math.exp(min(700, 1.5976 * z + 0.07056 * z**3)))
        total += math.floor(64 * (2 + 3 * math.log2(p)))
    return max(0, min(MAX_BITS, int(total / 64)))


def test_evidence_equals_brute_force(spark):
    rng = random.Random(13)
    pools = [x for _, _, x in ENCODINGS] + ["ab", "a", "aeiou_"]
    tokens = ["".join(rng.choices(rng.choice(pools), k=rng.randint(20, 90))) for _ in range(300)] + ["abcdefghijklmnopqrstuvwxyz0123456789", "0123456789" * 9, "x" * 5_000]
    rows = spark.createDataFrame(list(enumerate(tokens)), "doc_id long, text string")
    got = {r.doc_id: [t.bits for t in r.battery] for r in _scan(rows, rows.text, list(COSTS)).collect()}
    assert all(got[i] == [evidence(t)] for i, t in enumerate(tokens))


@pytest.mark.parametrize("size, n", [(10, 21), (16, 20), (26, 40), (36, 100), (62, 20), (64, 21), (67, MIN_TOKEN + 1), (67, 24), (67, 300)])
def test_factor_of_the_tests_has_a_bounded_mean(size, n):
    """Over uniform tokens, which the likelihood ratio turns the text model's mean into."""
    rng, count = np.random.default_rng(size * n), 30_000
    symbols = rng.integers(0, size, (count, n))
    y = 2 * symbols + 1 - size
    counts = np.zeros((count, size))
    for k in range(n):
        counts[np.arange(count), symbols[:, k]] += 1
    k = size - 1
    chi = ((((counts - n / size) ** 2).sum(axis=1) * size / n / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    even = (2 * (1 + ((y[:, 1:] > 0) != (y[:, :-1] > 0)).sum(axis=1)) - n - 1) / math.sqrt(n - 1)
    serial = (y[:, 1:] * y[:, :-1]).sum(axis=1) * n / ((y * y).sum(axis=1) * math.sqrt(n - 1))
    factor = np.prod([4 * (2 / (1 + np.exp(np.minimum(700, 1.5976 * z + 0.07056 * z**3)))) ** 3 for z in map(np.abs, (chi, even, serial))], axis=0)
    assert 1.1 < factor.mean() <= TESTS_MEAN


def test_costs_from_all_texts(spark):
    texts = [PROSE, None, "", "AAA+", PROSE]
    seen = [1 + sum(c in x for t in texts for c in t or "") for x in CLASSES]
    want = [min(k, math.floor(-64 * math.log2(n / sum(seen) / len(x)))) for n, x, k in zip(seen, CLASSES, MOST_COST)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert character_costs(rows, F.coalesce("text", F.lit(""))) == want
    assert sum(len(x) * 2 ** (-k / 64) for x, k in zip(CLASSES, want)) >= 1  # rounded in favour of text
    assert len(character_costs(rows.limit(0), F.col("text"))) == len(CLASSES)


def test_repeated_rows_and_ties(spark):
    token = "".join(random.Random(15).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=44))
    rows = [(i % 3, f"x {token} y") for i in range(6)] + [(9, PROSE * 300)]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 9").collect()
    assert len(got) == 6 and {tuple((s.start, s.end) for s in r.random) for r in got} == {((2, 2 + len(token)),)}


def test_many_spans_of_one_text(spark):
    text = "é token=abcdefgh AKIA" + "A" * 16 + "0123456789abcdef" * 2 + " "
    docs = spark.createDataFrame([(1, text * 2_000)], "doc_id long, text string")
    assert redact_secrets(docs).first().text == "é [SECRET] [SECRET] " * 2_000


def test_redaction(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'é token = "{key}" z', "en", 99), (2, "clean", "en", 5), (3, None, None, None), (4, "", "en", 0), (1, f'é token = "{key}" z', "en", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    out = redact_secrets(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.lang, r.n_chars) for r in out.collect()), key=str)
    assert got[0] == got[1] == (1, 'é [SECRET]" z', "en", 13)
    assert got[2:] == [(2, "clean", "en", 5), (3, None, None, None), (4, "", "en", 0)]


def test_edge_cases(spark):
    many = "token=abcdefgh " * 4000
    docs = spark.createDataFrame([(None, "AKIA" + "A" * 16, 1, "x"), (2, None, 1, "x"), (3, many, 1, "x")], "doc_id long, text string, body int, battery string")
    got = {r.doc_id: r for r in scan_secrets(docs).collect()}
    assert len(got[None].access) == 1 and not got[2].assign
    assert [(s.start, s.end) for s in got[3].assign[-2:]] == [(3998 * 15, 3998 * 15 + 14), (3999 * 15, 3999 * 15 + 14)]
    assert scan_secrets(docs.limit(0)).count() == 0
