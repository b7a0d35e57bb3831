"""Conversation structure repair: A* on the lattice of edits.

Method
------
Rows of a conversation are kept, reroled, deleted, or preceded by inserted empty turns, so that the initials of the roles form
``(s?(ua)+)?``. A node of the lattice is (rows read, state of the grammar). A* opens nodes by (cost plus heuristic, audit), where the audit is the
string of edits so far and the heuristic is the suffix sum of what no path avoids: a blank or repeated row is deleted, and a truncated one is
deleted or charged more. The heuristic is consistent, and two audits of equal cost that end in one node are never prefixes of each other,
so the first path to close a node is its cheapest with the least audit. Expansion yields letters in any order; the heap decides.

Scale. Rows are range-partitioned by (conversation, turn), so that a conversation of any size is spread over tasks, which read their rows
in order and hold a few blocks of ``BLOCK_ROWS`` at most. A conversation that lies inside a task is solved there. One that touches an edge of a
task is cut into blocks; A* runs from each state a block can start in, and a second, light pass joins the blocks: per grammar state the best
cost, audit and a running hash of the repaired text. Repeats are found by a grouped minimum over (conversation, role and text), combined before its shuffle.

Defined results: nulls of role and text are one space (blank); null conversation ids are one conversation; null turns come first and are not counted
in gaps. Rows of one turn go by the md5 of their role and text. Repeated rows are rows: all but the first are duplicates. An empty role has no initial:
it may be kept anywhere, and its neighbours are illegal. Texts of any length are streamed. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

#: A block ends with so many rows or characters; a conversation of more blocks isn't solved within one task.
BLOCK_ROWS, BLOCK_CHARS, HELD_BLOCKS = 512, 4_000_000, 2
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Grammar states: nothing yet, after the system, after a user, after an assistant. What each state may read, and whom an edit puts there.
_READS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_PUTS = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_ENDS = (0, 3)
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = ("su", "ua", "au")
#: Kinds of rows by their first fault.
_SOUND, _BLANK, _DUPLICATE, _TRUNCATED = range(4)


def repair_paths(initials: list[str], faults: list[int], start: int = 0, stop_at: Iterable[int] | None = None) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from ``start`` to each state that the rows can end in; only to the best of ``stop_at`` if that is given."""
    n = len(initials)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (min(DELETE, TRUNCATED) if faults[i] == _TRUNCATED else DELETE if faults[i] != _SOUND else 0)
    heap, closed, found = [(rest[0], "", 0, start)], set(), {}
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = f - rest[i]
        if i == n:
            found[state] = (cost, audit)
            if stop_at is not None and state in stop_at:
                return {state: found[state]}
        put = _PUTS[state][1]
        edits = [("I", INSERT, i, put)]
        if i < n:
            edits.append(("D", DELETE, i + 1, state))
            if faults[i] in (_SOUND, _TRUNCATED):
                charge = TRUNCATED if faults[i] == _TRUNCATED else 0
                edits.append(("R", REROLE + charge, i + 1, put))
                after = _READS[state].get(initials[i]) if initials[i] else state
                if after is not None:
                    edits.append(("K", charge, i + 1, after))
        for letter, price, j, after in edits:
            if (j, after) not in closed:
                heapq.heappush(heap, (cost + price + rest[j], audit + letter, j, after))
    return found


def apply_audit(audit: str, roles: list[str], texts: list[str], state: int = 0) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows."""
    i = 0
    for letter in audit:
        role, after = _PUTS[state]
        if letter == "I":
            yield role, ""
        elif letter == "R":
            yield role, texts[i]
        elif letter == "K":
            role, after = roles[i], _READS[state][roles[i][0]] if roles[i] else state
            yield role, texts[i]
        else:
            after = state
        state, i = after, i + (letter != "I")


class _Block:
    """Some rows of a conversation, in order."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.faults, self.chars = [], [], [], [], 0

    def full(self) -> bool:
        return len(self.turns) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(role) + len(text)

    def paths(self, starts: Iterable[int], stop_at: Iterable[int] | None = None) -> dict[int, dict[int, tuple[int, str]]]:
        initials = [r[:1] for r in self.roles]
        return {s: repair_paths(initials, self.faults, s, stop_at) for s in starts}


class _Fold:
    """A conversation read block by block: fault counts, and for each grammar state the best way to reach it."""

    def __init__(self):
        self.counts, self.illegal, self.initial = [0] * 4, 0, None
        self.least, self.most, self.distinct = None, None, 0
        self.ways = {0: (0, "", hashlib.sha256(), False)}

    def add(self, block: _Block, paths: dict[int, dict[int, tuple[int, str]]]) -> None:
        for turn, role, fault in zip(block.turns, block.roles, block.faults):
            self.counts[fault] += 1
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in _LEGAL
            self.initial = role[:1]
            if turn is not None:
                self.distinct += self.most != turn
                self.least, self.most = turn if self.least is None else self.least, turn
        best: dict[int, tuple[int, str, int, str]] = {}
        for start, (cost, audit, _, _) in self.ways.items():
            for end, (more, letters) in paths[start].items():
                if end not in best or (cost + more, audit + letters) < best[end][:2]:
                    best[end] = cost + more, audit + letters, start, letters
        self.ways = {end: (cost, audit, *self._hashed(block, start, letters)) for end, (cost, audit, start, letters) in best.items()}

    def _hashed(self, block: _Block, start: int, letters: str):
        digest, any_before = self.ways[start][2].copy(), self.ways[start][3]
        for role, text in apply_audit(letters, block.roles, block.texts, start):
            digest.update((("\n" if any_before else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            any_before = True
        return digest, any_before

    def result(self, conv_id) -> dict:
        cost, audit, digest, _ = min((self.ways[s] for s in _ENDS if s in self.ways), key=lambda w: w[:2])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return {
            "conv_id": conv_id, "gaps": gaps, "blank": self.counts[_BLANK], "duplicate": self.counts[_DUPLICATE], "truncated": self.counts[_TRUNCATED],
            "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest(),
        }


_RESULT = {**{c: pa.int64() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}, "audit": pa.string(), "repaired_sha256": pa.string()}
_PATHS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PARTS = {"part": pa.int64(), "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "faults": pa.list_(pa.int32()), "paths": _PATHS}
_RESULT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PARTS_DDL = "part long, turns array<bigint>, roles array<string>, texts array<string>, faults array<int>, paths array<struct<start: int, end: int, cost: bigint, audit: string>>"


def _part(conv_id, block: _Block, number: int) -> dict:
    paths = [{"start": s, "end": e, "cost": c, "audit": a} for s, ends in block.paths(range(4)).items() for e, (c, a) in ends.items()]
    return {"conv_id": conv_id, "part": number, "turns": block.turns, "roles": block.roles, "texts": block.texts, "faults": block.faults, "paths": paths}


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to results, or to blocks for the first and the last conversation of the task, which may go on in other tasks, and for long ones."""
    number, out, schema = TaskContext.get().partitionId() << 32, [], None
    conv, blocks, cut = None, [], True

    def leave(n: int) -> None:
        """The first ``n`` blocks go out unsolved."""
        nonlocal number
        for block in blocks[:n]:
            out.append(_part(conv, block, number))
            number += 1
        del blocks[:n]

    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *_RESULT.items(), *_PARTS.items()])
        for row in batch.to_pylist():
            if not blocks:
                conv, blocks = row["conv_id"], [_Block()]
            elif row["conv_id"] != conv:
                if cut:
                    leave(len(blocks))
                else:
                    fold = _Fold()
                    for block in blocks:
                        fold.add(block, block.paths(fold.ways, _ENDS if len(blocks) == 1 else None))
                    out.append(fold.result(conv))
                conv, blocks, cut = row["conv_id"], [_Block()], False
            elif blocks[-1].full():
                blocks.append(_Block())
                if cut or len(blocks) > HELD_BLOCKS:
                    cut = True
                    leave(len(blocks) - 1)
            blocks[-1].add(row["turn"], row["role"], row["text"], row["fault"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    if blocks:
        leave(len(blocks))
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted by conversation and number, to results."""
    conv, fold, schema = None, None, None
    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *_RESULT.items()])
        out = []
        for i in range(len(batch)):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if fold is None or row["conv_id"] != conv:
                if fold is not None:
                    out.append(fold.result(conv))
                conv, fold = row["conv_id"], _Fold()
            block, paths = _Block(), {s: {} for s in range(4)}
            block.turns, block.roles, block.texts, block.faults = row["turns"], row["roles"], row["texts"], row["faults"]
            for p in row["paths"]:
                paths[p["start"]][p["end"]] = p["cost"], p["audit"]
            fold.add(block, paths)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if fold is not None:
        yield pa.RecordBatch.from_pylist([fold.result(conv)], schema=schema)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of (conv_id, turn, role, text)."""
    ws = Workspace(turns.sparkSession, "repair")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    digest = F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"))
    rows = ws.save(rows.withColumn("digest", digest), "rows")
    stripped = F.rtrim(F.col("text"), F.lit(_SPACE))
    repeated = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first.row")
    joined = rows.join(repeated.withColumnRenamed("row", "first_row"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(stripped == "", _BLANK).when(F.col("first_row") != F.col("row"), _DUPLICATE).when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), _TRUNCATED).otherwise(_SOUND)
    keys = ["conv_id", "turn", "digest", "row"]
    spread = joined.select(*keys, "role", "text", fault.alias("fault")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = turns.schema["conv_id"].dataType.simpleString()
    solved = ws.save(spread.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_solve, f"conv_id {kind}, {_RESULT_DDL}, {_PARTS_DDL}"), "solved")
    columns = ["conv_id", *_RESULT]
    parts = solved.where("part is not null").select("conv_id", *_PARTS).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return solved.where("part is null").select(*columns).union(parts.mapInArrow(_join_parts, f"conv_id {kind}, {_RESULT_DDL}"))
