"""A learned embedder for use where no model is available: latent semantic analysis of the corpus by a randomised eigendecomposition.

A text is a vector of hashed words, weighted by the logarithm of their counts and by inverse document frequency, in ``BUCKETS`` places. The subspace of
largest variance is found by block power iteration: each pass multiplies the Gram matrix of all texts, which is summed over partitions and never built, with a narrow block.
Every row's part is a whole number, so sums are exact and the model doesn't depend on how rows are dealt. What passes the driver has a fixed size: document
frequencies and one block for each of up to ``SUM_PARTS`` partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIMENSIONS, OVERSAMPLE, PASSES = 4_096, 64, 16, 4
#: Scales of the whole numbers: weights of words in a text, the block, and what a text's product with the block is rounded to.
_TEXT, _BLOCK, _PRODUCT = 1 << 10, 1 << 12, 1 << 10
#: Texts that are expanded to whole vectors together; partial sums that are added on one machine.
BATCH, SUM_PARTS = 512, 16


def word_buckets(text: Column) -> Column:
    """The place of each word of a text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _weighted(places: np.ndarray, lengths: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of texts, a row for each; texts without words are zero."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    x = np.bincount(rows * BUCKETS + places, minlength=len(lengths) * BUCKETS).reshape(len(lengths), BUCKETS)
    x = np.log1p(x) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(column), BATCH):
        part = column.slice(i, BATCH)
        yield part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(part.offsets.to_numpy()).astype(np.int64)


def _products(shared):
    """One row: the sum over this partition's texts of x (x . block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, block = shared.value
        total = np.zeros(block.shape)
        for batch in batches:
            for places, lengths in _parts(batch.column("places")):
                x = np.rint(_weighted(places, lengths, idf) * _TEXT)
                y = np.rint(x @ block * (_PRODUCT / (_TEXT * _BLOCK)))
                total += x.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["part"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column("part"):
            own = np.frombuffer(part.as_py(), "<i8")
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


class LatentModel:
    """``idf`` of each place, and the projection of weighted texts."""

    def __init__(self, idf: np.ndarray, projection: np.ndarray):
        self.idf, self.projection = idf, projection

    def vectors(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        v = _weighted(places, lengths, self.idf) @ self.projection
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)


def fit_latent(texts: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> LatentModel:
    """Learn from all rows of ``texts``. Null and empty texts add nothing."""
    spark = texts.sparkSession
    rows = texts.select(word_buckets(F.col(text)).alias("places")).where(F.size("places") > 0)
    n = rows.count()
    found = rows.select(F.explode(F.array_distinct("places")).alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()  # a row for each place
    frequency = np.zeros(BUCKETS)
    for r in found:
        frequency[r.place] = r.n
    idf = np.log((1 + n) / (1 + frequency)) + 1
    block = np.linalg.qr(np.random.default_rng(17).standard_normal((BUCKETS, dimensions + OVERSAMPLE)))[0]
    for _ in range(PASSES):
        fixed = np.rint(block * _BLOCK)
        parts = rows.mapInArrow(_products(spark.sparkContext.broadcast((idf, fixed))), "part binary")
        summed = parts.repartition(SUM_PARTS * 8).mapInArrow(_added, "part binary").repartition(SUM_PARTS).mapInArrow(_added, "part binary").toArrow()
        gram = sum((np.frombuffer(p, "<i8") for p in summed["part"].to_pylist()), np.zeros(fixed.size, np.int64)).reshape(fixed.shape).astype(np.float64)
        before, block = fixed / _BLOCK, np.linalg.qr(gram)[0]
    small = before.T @ gram  # the Gram matrix within the last subspace
    values, inner = np.linalg.eigh((small + small.T) / 2)
    best = np.linalg.qr(gram)[0] if not values.any() else before @ inner[:, np.argsort(-values, kind="stable")[:dimensions]]
    best = best[:, :dimensions]
    return LatentModel(idf, best * np.sign(best[np.abs(best).argmax(axis=0), np.arange(best.shape[1])]))


def latent_embedding(model: LatentModel):
    """A function of a column of texts to a column of vectors (array<float>)."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for places in batches:
            out = []
            for i in range(0, len(places), BATCH):
                own = places.iloc[i : i + BATCH].tolist()
                lengths = np.array([len(p) for p in own], dtype=np.int64)
                out += list(model.vectors(np.concatenate([np.empty(0, np.int64), *own]).astype(np.int64), lengths))
            yield pd.Series(out)

    return lambda text: embed(word_buckets(text))
