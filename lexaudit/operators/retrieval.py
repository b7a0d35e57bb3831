"""Exact nearest regulation articles by squared L2 distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import RETRIEVED


#: Articles of a block, which one task holds at a time; bytes of the differences of some queries with them; bytes of article texts that are broadcast.
BLOCK_ARTICLES, BLOCK_BYTES, BROADCAST_BYTES = 10_000, 32_000_000, 32_000_000
#: Tasks of a search over several blocks; beyond that a task takes several blocks, one after the other.
MAX_TASKS = 20_000


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors that are not null and hold no null, for each length."""
    lengths = np.array(pc.fill_null(pc.list_value_length(column), -1))
    values = column.flatten()
    if values.null_count:
        owner = np.repeat(np.flatnonzero(lengths >= 0), lengths[lengths >= 0])
        lengths[np.unique(owner[np.asarray(values.is_null())])] = -1
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, np.asarray(column.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), n)


def _nearest(own: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of an article, distance) of the ``k`` nearest articles of each row, ties by their places."""
    squared = ((own[:, None, :] - vectors) ** 2).sum(axis=2).round(6)
    k = min(k, len(vectors))
    rows, places = np.nonzero(squared <= np.partition(squared, k - 1, axis=1)[:, k - 1 : k])
    found = squared[rows, places]
    order = np.lexsort((places, found, rows))
    rows = rows[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], places[order][kept], found[order][kept]


class _Block:
    """Articles in the order of their ids, by the length of their vectors."""

    def __init__(self, ids: pa.Array, column: pa.Array):
        self.ids, self.sizes = ids, {n: (at, matrix) for n, at, matrix in _by_size(column)}

    def hits(self, batch: pa.RecordBatch, keys: list[str], k: int) -> pa.RecordBatch:
        found: list[tuple] = [(np.empty(0, np.int64),) * 2 + (np.empty(0),)]
        for n, at, own in _by_size(batch.column("vector")):
            if n not in self.sizes:
                continue
            places, vectors = self.sizes[n]
            step = max(1, BLOCK_BYTES // (8 * max(1, n) * len(vectors)))
            for i in range(0, len(own), step):
                rows, near, distances = _nearest(own[i : i + step], vectors, k)
                found.append((at[i : i + step][rows], places[near], distances))
        rows, near, distances = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in keys), self.ids.take(pa.array(near)), pa.array(distances)], names=[*keys, "art_ord", "distance"])


def _search(block, keys: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield block.value.hits(batch, keys, k)

    return run


def _search_blocks(keys: list[str], k: int):
    """Rows come sorted by block and kind: the articles (kind 0) of a block by their ids, then the queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gathered, block = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            numbers, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind"))
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(batch)]):
                part = batch.slice(a, b - a)
                if numbers[a] != current:
                    current, gathered, block = numbers[a], [], None
                if kinds[a] == 0:
                    gathered.append(part)
                    continue
                if block is None and gathered:
                    block, gathered = _Block(*(pa.concat_arrays([x.column(c) for x in gathered]) for c in ("art_ord", "vector"))), []
                if block is not None:
                    yield block.hits(part, keys, k)

    return run


def nearest(queries: DataFrame, articles: DataFrame, keys: list[str], k: int = RETRIEVED) -> DataFrame:
    """keys, rank, art_ord, distance (six decimals): the k nearest articles, ties by art_ord; fewer if there are fewer articles.

    ``queries`` has the keys, which name a row, and ``vector``; ``articles`` has art_ord and ``vector``. Vectors that are null, hold a null or are
    of another length don't meet. Up to ``BLOCK_ARTICLES`` articles are broadcast. More are dealt to blocks by a hash of art_ord; each query goes to every block and streams
    past it, and no article passes the driver. A block gives a row's k best, so no row per pair is made, and only hits are ranked over the blocks.
    """
    spark, source = queries.sparkSession, queries.select(*keys, "vector")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("vector").schema)
    result = f"{kinds}, art_ord {articles.schema['art_ord'].dataType.simpleString()}, distance double"
    known = articles.where("art_ord is not null").select("art_ord", "vector")
    first = known.limit(BLOCK_ARTICLES + 1).toArrow()
    if len(first) <= BLOCK_ARTICLES:
        first = first.sort_by("art_ord").combine_chunks()
        whole = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (first["art_ord"], first["vector"])]
        found = source.mapInArrow(_search(spark.sparkContext.broadcast(_Block(*whole)), keys, k), result)
    else:
        n = -(-known.count() // BLOCK_ARTICLES)
        number = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")
        vector = F.col("vector").cast("array<double>").alias("vector")
        asked = source.select(number, F.lit(1).alias("kind"), *keys, F.lit(None).cast(known.schema["art_ord"].dataType).alias("art_ord"), vector)
        held = known.select(F.pmod(F.xxhash64("art_ord"), F.lit(n)).cast("int").alias("block"), F.lit(0).alias("kind"), *(F.lit(None).cast(source.schema[c].dataType).alias(c) for c in keys), "art_ord", vector)
        tasks = min(n, MAX_TASKS)
        streams = held.union(asked).repartitionById(tasks, F.col("block") % tasks).sortWithinPartitions("block", "kind", "art_ord")
        found = streams.mapInArrow(_search_blocks(keys, k), result)
    order = Window.partitionBy(*keys).orderBy("distance", "art_ord")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*keys, "rank", "art_ord", "distance")


def with_articles(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Hits with the id, title, text and concepts of their articles, which are broadcast if they take up to ``BROADCAST_BYTES``."""
    columns = articles.select("art_ord", "id", "title", "text", "related_concepts")
    size = columns.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return hits.join(F.broadcast(columns) if size <= BROADCAST_BYTES else columns, "art_ord")


def hashed_embedding(dimensions: int = 64):
    """A deterministic embedder of hashed words, for use where no model is available. Returns a pandas UDF: text -> array<float>."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        for texts in batches:
            out = []
            for text in texts:
                v = np.zeros(dimensions, dtype=np.float32)
                for word in (text or "").lower().split():
                    h = zlib.crc32(word.encode())
                    v[h % dimensions] += 1.0 if h & 0x10000 else -1.0
                norm = np.linalg.norm(v)
                out.append(v / norm if norm else v)
            yield pd.Series(out)

    return embed
