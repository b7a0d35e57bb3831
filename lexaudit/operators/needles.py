"""Which of many needles each text contains, by an Aho-Corasick automaton: one pass over a text, however many needles there are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the needles of one automaton, which takes up to about 50 bytes for each of them on every worker; more needles are cut into blocks, and texts pass each block's.
BLOCK_CHARS = 2_000_000
#: Needles that are looked for one by one; bytes of their rows, as JSON, up to which these are broadcast.
FEW, BROADCAST_BYTES = 32, 32_000_000
#: Characters of the texts that leave a task together.
OUT_CHARS = 16_000_000


class Automaton:
    """The needles of a block. ``first_places`` gives the place, from 1, where each of those that a text contains occurs first."""

    def __init__(self, needles: list[str]):
        import ahocorasick

        self.needles, self.empty = needles, "" in needles
        self.states = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, needle in enumerate(needles):
            if needle:
                self.states.add_word(needle, i)
        self.states.make_automaton()

    def first_places(self, text: str) -> dict[int, int]:
        found = {self.needles.index(""): 1} if self.empty else {}
        if len(self.states):
            for end, i in self.states.iter(text):
                if i not in found:
                    found[i] = end - len(self.needles[i]) + 2
        return found


def _blocks(words: DataFrame, block_chars: int) -> Iterator[list[str]]:
    block, size = [], 0
    for (word,) in words.toLocalIterator():
        block.append(word)
        size += len(word)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            rows, which, places, size = [], [], [], 0

            def out() -> pa.RecordBatch:
                take = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array([automaton.needles[i] for i in which], pa.string()), pa.array(places, pa.int32())], names=[*batch.schema.names, "_needle", "at"])

            for i, value in enumerate(batch.column(text)):
                own = value.as_py()
                if own is None:
                    continue
                for needle, at in automaton.first_places(own).items():
                    rows.append(i)
                    which.append(needle)
                    places.append(at)
                    size += len(own)
                    if size >= OUT_CHARS:
                        yield out()
                        rows, which, places, size = [], [], [], 0
            if rows:
                yield out()

    return run


def find_needles(rows: DataFrame, text: str, needles: DataFrame, needle: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``rows`` × ``needles`` whose column ``needle`` the column ``text`` contains, and ``at``: the place, from 1, of its first occurrence.

    Needles may repeat (each row of them is joined) and may be empty (every text contains them); null texts and null needles meet nothing. The distinct
    needles pass the driver block by block. Each block's automaton is broadcast, so texts aren't shuffled to be searched. Up to ``FEW`` needles are looked for by
    built-in functions, which keep generated code and the partitioning of ``rows``. Hits are joined to the other columns of ``needles`` by
    equality, with a broadcast if those take up to ``BROADCAST_BYTES``.
    """
    spark, found = rows.sparkSession, None
    words = needles.where(F.col(needle).isNotNull()).select(needle).distinct()
    few = [w for (w,) in words.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        listed = F.array(*map(F.lit, few)).cast("array<string>")
        held = rows.withColumn("_needle", F.explode(F.filter(listed, lambda w: F.contains(F.col(text), w))))
        found = held.withColumn("at", F.greatest(F.instr(F.col(text), F.col("_needle")), F.lit(1)))
    else:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        for block in _blocks(words, block_chars):
            hits = rows.mapInArrow(_search(spark.sparkContext.broadcast(Automaton(block)), text), f"{kinds}, _needle string, at int")
            found = hits if found is None else found.union(hits)
    size = needles.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return found.join(F.broadcast(needles) if size <= BROADCAST_BYTES else needles, F.col("_needle") == needles[needle]).drop("_needle")
