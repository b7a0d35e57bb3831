import json
import random

import pytest

from lexaudit.operators import contradictions
from lexaudit.operators.contradictions import candidate_pairs, parse_contradictions, requests
from lexaudit.operators.json_answers import parse_json_answers

GOOD = {"issues": [{"issue": "kept for ever", "regulation": "Article 5", "confidence": "high", "explanation": "e", "citation": 'says "always" {so}'}, {"issue": " "}, {"issue": "two", "confidence": 3}], "topic_tags": ["Data Retention", "data-retention", "b", None]}


def parsed(spark, *responses):
    rows = spark.createDataFrame([(i, 0, "S", True, r) for i, r in enumerate(responses)], "doc_id int, chunk_index int, position string, should_analyze boolean, response string")
    return sorted((r.doc_id, r.ord, r.description, r.regulation, r.confidence, r.citation, tuple(r.tags), r.repaired) for r in parse_json_answers(rows).collect())


def test_good_fenced_and_broken_answers(spark):
    text = json.dumps(GOOD)
    whole = [(0, "kept for ever", "Article 5", "High", 'says "always" {so}', ("b", "data_retention"), False), (2, "two", "Unknown Regulation", "Medium", "", ("b", "data_retention"), False)]
    trailing = text.replace('3}]', '3},]')
    cut = '{"topic_tags": ["x"], "issues": [{"issue": "first", "confidence": "Low"}, {"issue": "sec'
    got = parsed(spark, text, f"Sure!\n```json\n{text}\n```\nbye", trailing, cut, None, "", "no braces", "{}", '{"issues": "none", "topic_tags": {}}', '{"issues": [1, null, {"issue": "ok"}]}', "}{", "[" * 5000)
    assert [g[1:] for g in got if g[0] == 0] == whole and [g[1:] for g in got if g[0] == 1] == whole
    assert {g[2] for g in got if g[0] == 2} == {"two"} and all(g[7] for g in got if g[0] == 2)  # braces inside a text hide the first
    assert [g[1:] for g in got if g[0] == 3] == [(0, "first", "Unknown Regulation", "Low", "", ("x",), True)]
    assert {g[0] for g in got} <= {0, 1, 2, 3, 9}


def brute_force(rows):
    """Pairs by a look at all earlier findings of each."""
    denies = lambda t: any(w in t.split() for w in ("no", "not", "never"))
    out = {}
    for d, c, o, section, text, tags in rows:
        for tag in set(tags):
            before = [r for r in rows if r[0] == d and tag in r[5] and r[1] < c and denies(r[4]) != denies(text)]
            if before:
                last = max(before, key=lambda r: (r[1], r[2]))
                if last[3] != section:
                    out.setdefault((d, last[1], last[2], c, o), set()).add(tag)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("block", [1, 4, 256])
def test_pairs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(contradictions, "BLOCK_CHUNKS", block)
    rng = random.Random(block)
    # one document holds most findings, and one tag most of them
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), c, o, f"S{c % 7}", rng.choice(["data is kept", "data is not kept", "never shared", "knots are tied", "it is safe"]), ["hot"] * (rng.random() < 0.9) + rng.sample(["a", "b", "c", "a"], 2)) for c in range(60) for o in range(rng.randrange(1, 4))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, chunk_index int, ord int, section string, description string, tags array<string>, other string").repartition(3)
    got = {(r.doc_id, r.earlier_chunk, r.earlier_ord, r.later_chunk, r.later_ord): r.tags for r in candidate_pairs(df).collect()}
    assert got == brute_force(rows) and len(got) > 50
    assert len(got) <= len(rows) * 4  # a finding has a partner for each of its tags at most


def test_nulls_and_requests(spark):
    schema = "doc_id int, chunk_index int, ord int, section string, description string, tags array<string>"
    rows = [(1, 0, 0, "A", "kept {later_description}", ["t"]), (1, 1, 0, "B", "not kept", ["t", "t"]), (1, 2, 0, None, None, ["t"]), (1, 3, 0, "C", "never", None), (None, 0, 0, "A", "x", ["t"]), (2, 0, 0, "A", "no", ["t"])]
    pairs = candidate_pairs(spark.createDataFrame(rows, schema))
    asked = {r.chunk_index: r.prompt for r in requests(pairs).collect()}
    assert set(asked) == {1, 2} and "First (A): kept {later_description}\nSecond (B): not kept\n" in asked[1] and "speak of t." in asked[1]
    assert candidate_pairs(spark.createDataFrame([], schema)).count() == 0
    answers = ['[{"issue": "kept or not", "section": "A, B", "confidence": "low", "explanation": "why", "finding_type": "contradiction"}, {"issue": "other", "finding_type": "gap"}]', "```json\n[]\n```", "none", None]
    judged = spark.createDataFrame([(i, 0, "A / B", a) for i, a in enumerate(answers)], "doc_id int, chunk_index int, position string, response string")
    assert [tuple(r) for r in parse_contradictions(judged).collect()] == [(0, 0, 0, "kept or not", "A, B", "Low", "why")]
