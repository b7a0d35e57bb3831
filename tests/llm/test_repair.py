import hashlib
import itertools
import random
import re
import zlib

import pytest

from lexaudit.llm import repair
from lexaudit.llm.queries import op11_conversation_repair
from lexaudit.llm.repair import repair_conversations, repair_paths

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (role, text): None, blank, duplicate or truncated."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit of each row with up to three insertions at each place."""
    marks = faults(rows)
    edits = []
    for (role, text), mark in zip(rows, marks):
        charge = 5 if mark == "truncated" else 0
        own = [(2, "D", [])]
        if mark in (None, "truncated"):
            own += [(charge, "K", [(role, text)]), (1 + charge, "R", [("user", text)]), (1 + charge, "R", [("assistant", text)])]
        edits.append(own)
    inserts = [(5 * k, "I" * k, [(r, "") for r in roles]) for k in range(3) for roles in itertools.product(("user", "assistant"), repeat=k)]
    layers = [inserts]
    for own in edits:
        layers += [own, inserts]
    best = None
    todo = [(0, "", [])]
    for layer in layers:  # all prefixes that can still become legal, each with its best audit
        grown = {}
        for cost, audit, out in todo:
            for c, a, o in layer:
                new = out + o
                initials = "".join(r[:1] for r, _ in new)
                if not re.fullmatch(r"s?(ua)*u?", initials):
                    continue
                key = (initials[-1:], bool(initials))
                value = (cost + c, audit + a, new)
                if key not in grown or value[:2] < grown[key][:2]:
                    grown[key] = value
        todo = list(grown.values())
    for cost, audit, out in todo:
        if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, out
    return best


def everything(n):
    """All audits of up to n rows, without any pruning: for very short conversations."""
    for letters in itertools.product(("", "I", "II"), repeat=n + 1):
        for own in itertools.product("DKR", repeat=n):
            yield "".join(a + b for a, b in zip(letters, own)) + letters[-1]


def legal_cost(audit, rows):
    marks, i, out, cost = faults(rows), 0, "", 0
    for x in audit:
        put = "a" if out.endswith("u") else "u"
        if x == "I":
            out, cost = out + put, cost + 5
            continue
        role, mark = rows[i][0], marks[i]
        i += 1
        if x == "D":
            cost += 2
        elif mark in ("blank", "duplicate"):
            return None
        else:
            cost += (x == "R") + 5 * (mark == "truncated")
            out += role[:1] if x == "K" else put
    return cost if re.fullmatch(r"(s?(ua)+)?", out) else None


ROLES = ["user", "user", "assistant", "assistant", "system", "tool", ""]
TEXTS = ["a.", "b!", "c", "", " \n", "a.", "d?  ", "e. f", "é."]


def conversation(rng, n):
    return [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]


def test_exhaustive():
    rng = random.Random(1)
    kinds = {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}
    for n in (0, 1, 2, 3):
        for _ in range(12):
            rows = conversation(rng, n)
            costs = ((legal_cost(a, rows), a) for a in everything(n))
            want = min(c for c in costs if c[0] is not None)
            found = repair_paths([r[:1] for r, _ in rows], [kinds[f] for f in faults(rows)], 0, (0, 3))
            assert list(found.values()) == [want], rows
            assert cheapest(rows)[:2] == want


@pytest.mark.parametrize("block", [3, 512])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    rng = random.Random(2)
    table, want = [], {}
    for c in range(60):
        rows = conversation(rng, rng.choice([1, 2, 5, 9, 30]))
        turns = sorted(rng.sample(range(100), len(rows)))
        table += [(c, t, *r, "x") for t, r in zip(turns, rows)]
        cost, audit, out = cheapest(rows)
        marks = faults(rows)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
        want[c] = (turns[-1] - turns[0] + 1 - len(turns), *(marks.count(m) for m in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                   hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    rng.shuffle(table)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, fault string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(df).collect()}
    assert got == want


def test_hot_conversation(spark):
    # one conversation holds nearly all rows, and most of them are equal
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}." if i < 3000 else "same.") for i in range(6000)] + [(2, 0, "user", "q?"), (2, 1, "assistant", "a.")]
    got = {r.conv_id: r for r in repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    # of the equal ones each role's first stays, the others are deleted
    assert got[1].duplicate == 2998 and got[1].cost == 2 * 2998 and got[1].audit == "K" * 3002 + "D" * 2998
    assert (got[2].cost, got[2].audit) == (0, "KK")


def test_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, None, None, None), (None, 3, "user", "a."), (None, 5, "assistant", "b."), (7, None, "user", "x" * 3_000_000 + "."), (7, None, "assistant", "y")]
    got = {r.conv_id: r for r in repair_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert (got[None].gaps, got[None].blank, got[None].cost, got[None].audit) == (1, 1, 2, "DKK")
    assert got[7].gaps == 0 and got[7].truncated == 1
    assert repair_conversations(spark.createDataFrame([], schema)).count() == 0


def test_query_keeps_every_conversation(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    none = next(t for t in range(1000) if zlib.crc32(f" :{t}".encode()) % 20 > 4)
    spark.createDataFrame([(gone, 0, "user", "a."), (None, none, "user", "a.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[None].cost, got[None].audit) == (2, "D")
