import math
import random
import re
from collections import Counter, defaultdict

from lexaudit.llm.oracles import ORACLES
from lexaudit.llm.pii import REMOVED, sanitise, scan_pii
from lexaudit.llm.queries import op12_pii

from ..oracle import plain

SCHEMA = "doc_id long, text string, row string, body string"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    """The contract's patterns, as they are written."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    keep = {
        "email": (EMAIL, lambda m: True), "ip": (IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (CARD, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in keep.items()}


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: {k: [(s.start, s.end) for s in r[k]] for k in ("email", "ip", "card", "phone", "term")} for r in scan_pii(df).collect()}


TRICKY = [
    None, "", "a@b.c", "a@b.c@d.e", "a@b.c_d@e.f", "a@b..c", "a@b.c.", "..a@b.c..d@e.f", "x.@y.z", "a@b", "@b.c", "é@b.c", "a@é.c", "a@b.c﷐d@e.f", "﷐a@b.c﷑", "🙂a.b@c-d.e-f.g🙂+1 (555) 123-4567",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1", "0255.1.1.001", "1.2.3.4444444444444444444444", "x1.2.3.4y", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "-4111111111111111 ", "4111 1111 1111 1112",
    "4111 -1111", "1 4111 1111 1111 1111", "+1 (555) 123-4567", "+1(((", "+12345678", "+123456789 ", "+1234567890123456", "+1 555 123 4567 +44 20 7946 0958", "+-1", "00000000000000000000 000000000000",
]


def test_base_kinds(spark):
    rng = random.Random(6)
    texts = TRICKY + ["".join(rng.choice("aZ0159.@-_+ ()%é﷐") for _ in range(rng.choice([20, 200]))) for _ in range(400)]
    texts += ["".join(rng.choice("12. -+") for _ in range(300)) for _ in range(100)] + ["".join(rng.choice("a.@b") for _ in range(300)) for _ in range(100)]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        assert {k: v for k, v in got[i].items() if k != "term"} == base(t or ""), repr(t)


def test_long_texts(spark):
    # runs that a pattern could read again and again, or by recursion
    texts = ["a" * 300_000, "1" * 300_000, "a@" + "b." * 150_000 + "c", "1-" * 150_000 + "1", "+1" + "(" * 300_000, ". " * 150_000 + "x@y.z", "é" * 5_000 + " " + "w" * 10_000 + " x@y.z"]
    got = scanned(spark, texts)
    assert got[2]["email"] == [(0, len(texts[2]))] and got[5]["email"] == [(300_000, 300_005)] and got[6]["email"] == [(15_002, 15_007)]
    assert not any(got[0].values()) and not any(got[3].values())


def corpus(rng):
    """Filler of common words; one address stands near a code name, another near words that stand everywhere."""
    common = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [filler(60) for _ in range(300)]
    texts += [f"{filler(20)} Operation Nightjarring leader mary.x@corp.example {filler(20)}" for _ in range(6)]
    texts += [f"{filler(30)} nightjarring was seen {filler(10)}", "nightly nightly nights", "Zanzibar!"] + ["nightfall nightmare " * 200]
    texts += [f"{filler(20)} zanzibar calls +1 (555) 123-4567 {filler(20)}" for _ in range(4)]
    texts += ["quokka writes to joe@corp.example at once"] * 30  # copies are one context
    return texts


def expected_terms(texts):
    """Terms to sanitise, by the definition."""
    words = lambda t: [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", t) if 3 <= len(m.group().lower()) <= 40]
    n_t, n_e, n_et, contexts = Counter(w for t in texts for _, _, w in words(t)), Counter(), Counter(), defaultdict(set)
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    for t in texts:
        for kind, spans in base(t).items():
            every = [(m.start(), m.end()) for m in re.finditer(patterns[kind], t)]
            for a, b in spans:
                at = every.index((a, b))
                before = t[every[at - 1][1] if at else 0 : a]
                after = t[b : every[at + 1][0] if at + 1 < len(every) else len(t)]
                before = re.sub(r"^[^\W_]+", "", before[-100:]) if len(before) > 100 else before
                after = re.sub(r"[^\W_]+$", "", after[:100]) if len(after) > 100 else after
                e = kind, re.sub("[^0-9]", "", t[a:b]) if kind in ("card", "phone") else t[a:b].lower()
                for _, _, w in words(before) + words(after):
                    n_e[e] += 1
                    n_et[e, w] += 1
                    contexts[e, w].add((before, after))
    n = sum(n_t.values())
    return {w for (e, w), k in n_et.items() if len(contexts[e, w]) >= 3 and math.log(min(k, n_t[w]) * n / (n_t[w] * n_e[e])) / math.log(n / n_e[e]) >= 0.9}


def test_revealing_terms(spark):
    texts = corpus(random.Random(7))
    want = expected_terms(texts)
    assert {"nightjarring", "operation", "leader", "zanzibar"} <= want and "quokka" not in want and len(want) < 10
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        inside = [s for spans in base(t).values() for s in spans]
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if m.group().lower() in want and not any(m.start() < b and m.end() > a for a, b in inside)]
        assert got[i]["term"] == spans
    assert any(not any(base(t).values()) and got[i]["term"] for i, t in enumerate(texts))  # a text that names no one reveals as well


def test_sanitise(spark):
    texts = corpus(random.Random(7)) + ["x" * 5_000 + " joe@corp.example " + "🙂y" * 5_000 + " +1 (555) 123-4567", None]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in sanitise(df).collect()}
    assert rows[len(texts) - 1].text is None and rows[0].row == "x" and rows[0].body == "y"
    assert rows[len(texts) - 2].text == "x" * 5_000 + " [EMAIL] " + "🙂y" * 5_000 + " [PHONE]"
    named = next(i for i, t in enumerate(texts) if "Nightjarring" in t)
    # nig* stands for nightfall and nightmare too, so it says little; nothing else begins like zanzibar
    assert f"{REMOVED} nig* {REMOVED} [EMAIL]" in rows[named].text
    assert f"{REMOVED} calls [PHONE]" in " ".join(r.text for r in rows.values() if r.text) or f"{REMOVED} {REMOVED} [PHONE]" in " ".join(r.text for r in rows.values() if r.text)
    assert not any(w in (r.text or "").lower() for r in rows.values() for w in ("nightjarring", "mary.x", "zanzibar!"))


def test_query_against_sql(spark, tmp_path):
    import duckdb

    texts = corpus(random.Random(8)) + TRICKY
    spark.createDataFrame([(i % 340 if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = c.execute(ORACLES["op12_pii"])
    names = [d[0] for d in result.description]
    got = op12_pii(spark, str(tmp_path)).select(*names).collect()
    assert sorted(repr(plain(tuple(r))) for r in got) == sorted(repr(plain(tuple(r))) for r in result.fetchall())
    assert sum("term" in r.spans for r in got) > 10


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scan_pii(empty).count() == 0 and sanitise(empty).columns == empty.columns and sanitise(empty).count() == 0
