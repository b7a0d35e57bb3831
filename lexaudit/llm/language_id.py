"""Language identification by bit-sliced Bloom filters over character n-grams.

Method
------
Training counts the character n-grams of each language over a bounded sample of labelled documents and keeps the most
frequent ones. All languages share one table of slots; bit l of a slot belongs to the filter of language l. A lookup
ANDs the slots of an n-gram's hashes, which returns the mask of all languages that contain it. For a document,
the bits are counted per language, and the count is corrected for the false positives that the fill of the language's
slice predicts: rate = (hits / n-grams - fpr) / (1 - fpr). The language with the highest rate wins; the score is its
share of the sum of rates, which falls as more languages are learned; its own rate doesn't, and is what to reject texts by.

N-grams are taken over the whole lower-cased text, in which every run of characters that are not letters is one space.

Defined results: ``und`` with score 0 if the text is null or has no letter. Ties go to the first language in order. If
no n-gram is known the first language is given with score 0. Without training rows every text is ``und``. Rows with a null
doc_id are predicted like others and never used for training. Repeated rows are predicted each, and counted each if they are in the sample. A
text of any length is read in pieces with the same result. An empty table gives no rows. Other columns are passed on; columns with the
names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import bounded_sample
from .shingles import U64, mix, text_blocks

#: Lengths of the n-grams, and how many are kept of each language and length.
SIZES, GRAMS = (3, 4), 600
#: The bounded training sample: documents of each language, chosen by a hash of doc_id; and the most languages learned.
SAMPLE_DOCS, MAX_LANGUAGES = 400, 256
SLOTS, HASHES = 1 << 18, 3
UNDETERMINED = "und"
#: Characters that are read at a time.
_PIECE = 1 << 20

_LETTER = np.zeros(0, dtype=bool)


def letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def grams(texts: list[bytes | None]) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """Piece by piece: for each n-gram length the hashes of the n-grams that end in the piece and the text of each; and the letters of each text in it.

    The texts are lower-cased whole and read in pieces of ``_PIECE`` characters, whose last places are carried into the next.
    """
    letter = letters()
    parts = [f" {(t or b'').decode('utf-8').lower()} " for t in texts]
    joined, stops = "".join(parts), np.cumsum([len(p) for p in parts])
    longest = max(SIZES) - 1
    old_codes, old_owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    after_letter, last_owner = False, -1
    for at in range(0, len(joined), _PIECE):
        codes = np.frombuffer(joined[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        owner = np.searchsorted(stops, np.arange(at, at + len(codes)), "right")
        is_letter = letter[codes]
        counts = np.bincount(owner, weights=is_letter, minlength=len(parts))
        keep = is_letter | np.append(after_letter, is_letter[:-1]) | (owner != np.append(last_owner, owner[:-1]))
        after_letter, last_owner = bool(is_letter[-1]), int(owner[-1])
        codes = np.append(old_codes, np.where(is_letter, codes, 32).astype(np.uint64)[keep])
        owner = np.append(old_owner, owner[keep])
        out = []
        for n in SIZES:
            skip = max(0, len(old_codes) - n + 1)
            own, of = codes[skip:], owner[skip:]
            count = len(own) - n + 1
            if count <= 0:
                out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
                continue
            h = np.full(count, n, dtype=np.uint64)
            for k in range(n):
                h = h * U64(0x100000001B3) + own[k : k + count]
            inside = of[:count] == of[n - 1 :]
            out.append((mix(h[inside]), of[:count][inside]))
        old_codes, old_owner = codes[-longest:], owner[-longest:]
        yield out, counts


def _slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    step = (hashes >> U64(32)) | U64(1)
    for k in range(HASHES):
        yield ((hashes + U64(k) * step) & U64(SLOTS - 1)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # SLOTS x words of 64 languages

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> LanguageModel:
        """members: the n-gram hashes of each language."""
        languages = sorted(members)
        table = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), dtype=np.uint64)
        for l, name in enumerate(languages):
            for slot in _slots(members[name]):
                table[slot, l // 64] |= U64(1 << (l % 64))
        return cls(languages, table)

    def false_positive_rates(self) -> np.ndarray:
        fill = [np.count_nonzero((self.table[:, l // 64] >> U64(l % 64)) & U64(1)) / SLOTS for l in range(len(self.languages))]
        return np.array(fill) ** HASHES

    def rates(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected rate of each text and language; whether each text has a letter."""
        hits = np.zeros((len(texts), len(self.languages)))
        total, letters_of = np.zeros(len(texts)), np.zeros(len(texts))
        for found, counts in grams(texts):
            letters_of += counts
            self._add(found, hits, total)
        fpr = self.false_positive_rates()
        return np.maximum(0.0, (hits / np.maximum(total, 1)[:, None] - fpr) / (1 - fpr)), letters_of > 0

    def _add(self, found: list[tuple[np.ndarray, np.ndarray]], hits: np.ndarray, total: np.ndarray) -> None:
        """Count the n-grams of a piece, and those that each language holds."""
        for hashes, owner in found:
            total += np.bincount(owner, minlength=len(total))
            slots = list(_slots(hashes))
            for w in range(self.table.shape[1]):
                column = self.table[:, w]
                mask = column[slots[0]]
                for slot in slots[1:]:
                    mask &= column[slot]
                for l in range(64 * w, min(64 * w + 64, len(self.languages))):
                    hits[:, l] += np.bincount(owner, weights=(mask >> U64(l % 64)) & U64(1), minlength=len(total))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and own rate of the winner."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rates, has_letter = self.rates(texts)
        best = rates.argmax(axis=1)
        top, total = rates[np.arange(len(texts)), best], rates.sum(axis=1)
        score = np.where(has_letter & (total > 0), top / np.where(total > 0, total, 1), 0.0)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter)], score, np.where(has_letter, top, 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for start, texts in text_blocks(batch, "text"):
            names, code = np.unique(np.array(langs[start : start + len(texts)], dtype=object), return_inverse=True)
            for size, (hashes, owner) in ((n, part) for found, _ in grams(texts) for n, part in zip(SIZES, found)):
                for l, name in enumerate(names):
                    values, counts = np.unique(hashes[code[owner] == l], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(np.full(len(values), size, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)], names=["lang", "size", "gram", "c"])


def fit_language_model(docs: DataFrame, training: Column, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Learn from text and lang of up to ``sample_docs`` rows of each language that meet ``training``."""
    usable = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen = bounded_sample(usable.select("doc_id", "lang"), "doc_id", "lang", sample_docs, MAX_LANGUAGES).distinct()
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, size int, gram long, c long").groupBy("lang", "size", "gram").agg(F.sum("c").alias("c"))
    best = Window.partitionBy("lang", "size").orderBy(F.desc("c"), "gram")
    top = counts.withColumn("at", F.row_number().over(best)).where(F.col("at") <= GRAMS).select("lang", "gram").toPandas()
    return LanguageModel.build({name: part["gram"].to_numpy(np.int64).view(np.uint64) for name, part in top.groupby("lang")})


def identify_languages(docs: DataFrame, model: LanguageModel, pred: str = "lang_pred", score: str = "score", rate: str | None = None) -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score, and with its own rate if that is named."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [pred, score] + ([rate] if rate else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rates = [], [], []
            for _, texts in text_blocks(batch, "text", 1_000_000):
                own, own_scores, own_rates = shared.value.predict(texts)
                names += own
                scores += own_scores.tolist()
                rates += own_rates.tolist()
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())][: len(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *added])

    kept = docs.drop(*added)
    kinds = [f"`{c}` {kind}" for c, kind in zip(added, ("string", "double", "double"))]
    return kept.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + kinds))


def fold(column: Column, parts: int) -> Column:
    """The remainder of crc32 of an id's text."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts))
