"""Benchmark decontamination by size-partitioned MinHash containment search.

Method
------
The search follows LSH Ensemble: domains are partitioned by size, and in each partition a containment threshold becomes a
Jaccard threshold. Test items are partitioned by their number of shingles into classes (u / 2, u]. For a class a
document is cut into overlapping windows of 1.5 u shingles at steps of u / 2, so that any u neighbouring shingles lie in
one window: an item contained to 0.8 has a Jaccard similarity of 0.25 or more with its window, however long the
document is. Windows and items get about 64 minima each, from several hash functions whose range is split into bins;
a window that shares any minimum with an item is a candidate (missed with a probability below 1e-5 at the
threshold). Candidates are verified on the exact sets: shingles of the item that the whole document holds.

The items are the query side. They go to the executors in blocks of bounded size; the documents are read once per block.

Defined results: shingles are runs of n lower-cased words, or the whole sequence of a shorter text. Null or empty texts
and items have none and match nothing. Items that repeat each give their own rows; documents too. A very long text is read whole, in windows. Empty tables give
no rows. Extra columns are ignored by ``find_items`` and passed on by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shingles import U64, mix, shingle_hashes, text_blocks, word_hashes

MINIMA = 64
MAX_BINS = 16
#: Items of one block: at most so many rows, whose texts hold at most so many bytes together.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32_000_000
_FILTER_BITS = 20
_TOP = np.iinfo(np.uint64).max


class ItemIndex:
    """Minima of the test items, by size class."""

    def __init__(self, texts: list[bytes | None], n: int, percent: int):
        words, offsets = word_hashes(texts)
        self.n, self.percent = n, percent
        self.sets = list(shingle_hashes(words, offsets, n))
        self.classes: list[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = []
        uppers = np.array([1 << (len(s) - 1).bit_length() if len(s) else 0 for s in self.sets])
        for u in sorted(set(uppers[uppers > 0].tolist())):
            members = np.flatnonzero(uppers == u)
            bins = min(MAX_BINS, max(1, u // 2))
            tables = []
            for seed in range(MINIMA // bins):
                values, owners = [], []
                for i in members:
                    v = seeded(self.sets[i], seed)
                    least = np.full(bins, _TOP, dtype=np.uint64)
                    np.minimum.at(least, bin_of(v, bins), v)
                    values.append(least[least < _TOP])
                    owners.append(np.full(len(values[-1]), i))
                values, owners = np.concatenate(values), np.concatenate(owners)
                order = np.argsort(values, kind="stable")
                known = np.zeros(1 << _FILTER_BITS, dtype=bool)
                known[values & U64((1 << _FILTER_BITS) - 1)] = True
                tables.append((values[order], owners[order], known))
            self.classes.append((u, bins, tables))

    def search(self, rolled: np.ndarray, lengths: np.ndarray) -> set[tuple[int, int]]:
        """Candidate (text, item) pairs; ``rolled`` holds the texts' shingles in order of their places."""
        found: set[tuple[int, int]] = set()
        if not len(rolled):
            return found
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(rolled)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        hashed: dict[int, np.ndarray] = {}
        for u, bins, tables in self.classes:
            step = max(1, u // 2)
            blocks = -(-lengths // step)
            first = np.cumsum(blocks) - blocks
            slot = (first[text] + place // step) * bins
            owner = np.repeat(np.arange(len(lengths)), blocks)
            for seed, (values, owners, known) in enumerate(tables):
                v = hashed.get(seed)
                if v is None:
                    v = hashed[seed] = seeded(rolled, seed)
                least = np.full((len(owner), bins), _TOP, dtype=np.uint64)
                np.minimum.at(least.reshape(-1), slot + bin_of(v, bins), v)
                window = least.copy()
                for ahead in (1, 2):
                    if len(owner) > ahead:
                        same = owner[ahead:] == owner[:-ahead]
                        np.minimum(window[:-ahead], least[ahead:], out=window[:-ahead], where=same[:, None])
                row, col = np.nonzero(known[window & U64((1 << _FILTER_BITS) - 1)])
                hit = window[row, col]
                lo, hi = np.searchsorted(values, hit, "left"), np.searchsorted(values, hit, "right")
                for r, a, b in zip(row[hi > lo], lo[hi > lo], hi[hi > lo]):
                    found.update((int(owner[r]), int(i)) for i in owners[a:b])
        return found

    def matches(self, texts: list[bytes | None]) -> list[tuple[int, int, int]]:
        """Verified (text, item, shared shingles)."""
        words, offsets = word_hashes(texts)
        sets = list(shingle_hashes(words, offsets, self.n))
        places = np.maximum(offsets[1:] - offsets[:-1] - self.n + 1, 0)
        ordered = [s if not k else None for s, k in zip(sets, places)]
        if len(words) >= self.n:
            runs = shingle_places(words, self.n)
            ordered = [runs[a : a + k] if k else s for a, k, s in zip(offsets[:-1], places, sets)]
        lengths = np.array([len(x) for x in ordered], dtype=np.int64)
        out = []
        for t, i in sorted(self.search(np.concatenate(ordered), lengths)) if len(ordered) else []:
            shared = len(np.intersect1d(self.sets[i], sets[t], assume_unique=True))
            if 100 * shared >= self.percent * len(self.sets[i]):
                out.append((t, i, shared))
        return out


def seeded(shingles: np.ndarray, seed: int) -> np.ndarray:
    return mix(shingles + U64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64))


def bin_of(values: np.ndarray, bins: int) -> np.ndarray:
    return (values >> U64(60)).astype(np.int64) & (bins - 1)


def shingle_places(words: np.ndarray, n: int) -> np.ndarray:
    """The shingle that starts at each word, across the borders of texts too; equal to those of shingle_hashes."""
    return next(shingle_hashes(words, np.array([0, len(words)]), n, ordered=True))


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[bytes | None]]]:
    """Blocks of (ids, texts) of bounded size."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator(prefetchPartitions=False):
        text = r.text.encode() if r.text is not None else None
        ids.append(r.id)
        texts.append(text)
        size += len(text or b"")
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_items(docs: DataFrame, items: DataFrame, shingle_words: int = 5, percent: int = 80, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every item whose shingles a document holds to ``percent`` or more."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = source.schema["doc_id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    id_type = to_arrow_type(items.schema[item_col].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_item_shingles int, n_shared int, containment double"
    out = None
    for ids, texts in _item_blocks(items, item_col, text_col):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, texts = shared.value
            index = ItemIndex(texts, shingle_words, percent)
            for batch in batches:
                for start, own in text_blocks(batch, "text"):
                    found = index.matches(own)
                    if found:
                        sizes = [len(index.sets[i]) for _, i, _ in found]
                        doc_ids, item_ids = batch.column("doc_id").take(pa.array([start + t for t, _, _ in found])), pa.array([ids[i] for _, i, _ in found], id_type)
                        yield pa.RecordBatch.from_arrays(
                            [doc_ids, item_ids, pa.array(sizes, pa.int32()), pa.array([c for _, _, c in found], pa.int32()), pa.array([c / n for (_, _, c), n in zip(found, sizes)])],
                            names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
                        )

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, shingle_words: int = 5, percent: int = 80, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item to ``percent`` or more, with all their columns."""
    for _, texts in _item_blocks(items, item_col, text_col):
        shared = docs.sparkSession.sparkContext.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, shingle_words, percent)
            for batch in batches:
                keep = np.ones(len(batch), dtype=bool)
                for start, own in text_blocks(batch, text_col):
                    keep[[start + t for t, _, _ in index.matches(own)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
