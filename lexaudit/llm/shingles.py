"""Vectorised word and shingle hashing over blocks of whole texts.

Words are runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. A word hashes to a polynomial over random
byte values modulo 2^64, which prefix sums give for all words of a block at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_SEED = np.random.default_rng(20240611)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_WORD_BYTE = np.ones(256, dtype=np.int8)
_WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_POWERS: dict[int, np.ndarray] = {}
#: Bytes that are hashed at a time.
_PIECE = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, U64(base), dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = np.multiply.accumulate(have)
    return _POWERS[base][:n]


def text_blocks(batch: pa.RecordBatch, column: str, max_bytes: int = 1_000_000) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, encoded texts) of runs of rows that hold about max_bytes; a longer text is a run of its own."""
    values = batch.column(column).cast(pa.large_binary())
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(values):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield start, values.slice(start, stop - start).to_pylist()
        start = stop


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each text's words in them (len(texts) + 1).

    The bytes are read in pieces; a word that goes on in the next piece is carried over, so memory beyond the texts and the
    words' hashes is bounded.
    """
    parts = [t or b"" for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    data = np.frombuffer((b" ".join(parts) + b" ").lower(), dtype=np.uint8)
    found, places = [], []
    carried, length, place = U64(0), 0, 0  # of the word that is open at the end of a piece
    for at in range(0, len(data), _PIECE):
        piece = data[at : at + _PIECE]
        edge = np.diff(_WORD_BYTE[piece], prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * _powers(_BASE, len(piece)), out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _powers(_BASE_INV, len(piece))[starts]
        starts = starts + at
        if length and len(starts) and starts[0] == at:
            hashes[0] = (int(carried) + int(hashes[0]) * pow(_BASE, length, 2**64)) % 2**64
            starts[0] = place
        elif length:
            hashes, starts, ends = np.append(carried, hashes), np.append(place, starts), np.append(0, ends)
        length = 0
        if len(ends) and ends[-1] == len(piece):
            carried, place = hashes[-1], int(starts[-1])
            length = at + len(piece) - place
            hashes, starts = hashes[:-1], starts[:-1]
        found.append(hashes)
        places.append(starts)
    starts = np.concatenate(places)
    offsets = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return mix(np.concatenate(found)), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int, ordered: bool = False) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles, sorted (``ordered``: all of them, by place); with fewer than n words the whole sequence as one shingle; none without words."""
    if len(words) >= n:
        rolled = words[: len(words) - n + 1] * U64(3)
        for k in range(1, n):
            rolled = mix(rolled + U64(k)) + words[k : len(words) - n + 1 + k] * U64(2 * k + 3)
        rolled = mix(rolled)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= n:
            yield rolled[a : b - n + 1] if ordered else np.unique(rolled[a : b - n + 1])
        elif b > a:
            short = words[a : a + 1] * U64(3)
            for k in range(1, b - a):
                short = mix(short + U64(k)) + words[a + k : a + k + 1] * U64(2 * k + 3)
            yield mix(short + U64(b - a))
        else:
            yield np.empty(0, dtype=np.uint64)
