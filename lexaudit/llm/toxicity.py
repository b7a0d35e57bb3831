"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine over labelled sentences.

Method
------
Texts are lower-cased; runs of other characters than letters become one space, and runs of three or more single letters
(a spaced-out word) are joined. Sentences end at a line end or at ``. ! ?`` before a space, and after ``MAX_SENTENCE`` places. The
kernel compares windows of a sentence, of ``WINDOWS`` places: every subsequence of ``LENGTH`` characters (spaces count)
within ``SPAN`` places has the weight DECAY to the power of the places it spans, so that a gap, an inserted character or a split
word costs a factor and not the match. The norm of a window is that of one without repeated subsequences. A sentence's
decision is that of its best window.

Training reads a bounded sample of sentences of labelled documents; a sentence has its document's label, and a toxic label
says only that some window of some sentence is toxic. So the machine is a multiple-instance one: (1) the first decision is
the difference of the two classes' mean embeddings, scaled per subsequence; (2) every toxic document gives the best windows of
its best sentences, every clean one the most toxic-looking windows of several sentences; (3) some of both become Nyström
landmarks, in whose feature space a linear SVM (squared hinge) is trained, also on toxic windows with a character put in; (4) the
machine chooses the windows anew, ``ROUNDS`` times. Subsequences are counted in hashed buckets (2^BUCKET_BITS; a bucket shared by two subsequences is
one feature), so the machine collapses to one weight per bucket, and a text is scored by prefix sums over its places.

A text's features are the decision on its best window, and the logarithms of the mass of its toxic places and of its length; a logistic
model turns them into the score.

Defined results: null, empty and letterless texts get the score of a text without a sentence, which is low. Repeated rows are each
scored, and trained each if labelled, within the bound of the sample. A text beyond ``_PIECE`` characters is scored in pieces, cut after a line end or
a space, so memory doesn't grow with it beyond the text itself. Without both labels in training every score is 0. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import letters
from .sampling import bounded_rows, bounded_sample
from .shingles import U64, text_blocks

LENGTH, SPAN, DECAY = 4, 5, 0.6
WINDOWS = (6, 9, 12)
BUCKET_BITS = 20
LANDMARKS, ROUNDS = 192, 3
RIDGE = 2e-3
#: The bounded training sample: labelled documents of each kind, chosen by a hash of doc_id; sentences of each, chosen by their own hash;
#: of a sentence beyond MAX_SENTENCE characters one part of that length, chosen by its hash.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 2_500
SENTENCES_TOXIC, SENTENCES_CLEAN = 40, 16
MAX_SENTENCE = 400
#: Sentences of a clean document that give a negative example in each round; of a toxic one, a positive.
NEGATIVES, POSITIVES = 2, 2
#: The weight of all negative examples together, when that of the positive ones is 1.
NEGATIVE_WEIGHT = 4.0
#: Positive examples are also trained with a letter or a space put in, with this weight together.
DISTURBED_WEIGHT = 0.25
#: A place counts as toxic from this decision on.
TOXIC_FROM = 0.3
_PIECE = 1_000_000
#: A long training sentence in parts that end at white space where there is some.
_PARTS = re.compile(rf".{{1,{MAX_SENTENCE}}}(?!\S)|.{{1,{MAX_SENTENCE}}}", re.S)
_CHOICES = [(0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1)]
_MULT = [U64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)][:LENGTH]
_STOPS = [ord(c) for c in ".!?"]


def _norm(size: int) -> float:
    return float(np.sqrt(sum((size - c[-1]) * DECAY ** (2 * (c[-1] + 1)) for c in _CHOICES if size > c[-1])))


class Sentences:
    """The sentences of a block of texts as one array of code points: places ``[start, stop)`` of each, and the text it is of."""

    def __init__(self, texts: list[str]):
        parts = [f"\n{t.lower()}\n".replace("\n", "\n ") for t in texts]
        raw = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = letters()[raw]
        border = raw == 10
        border[:-1] |= np.isin(raw[:-1], _STOPS) & ((raw[1:] == 32) | ((raw[1:] >= 9) & (raw[1:] <= 13)))
        edge = np.diff(letter.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # words
        if not len(begin):
            self.codes, self.start, self.stop, self.text = np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
            return
        borders = np.concatenate([[0], np.cumsum(border)])
        cut = borders[begin[1:]] > borders[end[:-1]]  # the gap after a word holds a border
        size = end - begin
        close = (size[:-1] == 1) & (size[1:] == 1) & ~cut & (begin[1:] - end[:-1] <= 3)
        joint = close & (np.append(False, close[:-1]) | np.append(close[1:], False))
        place = np.cumsum(size + 1) - size - 1
        base = np.repeat(place[np.append(0, np.flatnonzero(cut) + 1)], np.diff(np.concatenate([[0], np.flatnonzero(cut) + 1, [len(begin)]])))
        part = (place - base) // MAX_SENTENCE
        cut |= part[1:] != part[:-1]
        last = np.append(np.flatnonzero(cut), len(begin) - 1)
        first = np.append(0, last[:-1] + 1)
        keep = letter.copy()
        keep[begin[~np.append(False, joint & ~cut)] - 1] = True  # a space before each word
        keep[end[last]] = True  # and one after each sentence
        at = np.cumsum(keep)
        self.codes = np.where(letter, raw, 32)[keep].astype(np.uint64)
        self.start, self.stop = at[begin[first] - 1] - 1, at[end[last]]
        self.text = np.searchsorted(np.cumsum([len(p) for p in parts]), begin[first], "right")


def _buckets(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each choice of places its reach, and the bucket of the subsequence from each position that has it."""
    scaled = [codes * m for m in _MULT]
    for c in _CHOICES:
        count = max(0, len(codes) - c[-1])
        total = sum(scaled[k][c[k] : c[k] + count] for k in range(LENGTH))
        yield c[-1], (total >> U64(64 - BUCKET_BITS)).astype(np.int64)


def place_scores(block: Sentences, table: np.ndarray) -> np.ndarray:
    """For each place the largest sum of weights of the windows that start there."""
    n = len(block.codes)
    sums: dict[int, np.ndarray] = {}
    for reach, bucket in _buckets(block.codes):
        sums[reach] = sums.get(reach, 0) + table[bucket]
    totals = {reach: np.append(0.0, np.cumsum(v, dtype=np.float64)) * DECAY ** (reach + 1) for reach, v in sums.items()}
    begin = np.arange(n)
    stop = np.repeat(block.stop, np.diff(np.append(block.start, n))) if n else begin
    best = np.full(n, -np.inf)
    for size in WINDOWS:
        end = np.minimum(begin + size, stop)
        own = np.zeros(n)
        for reach, total in totals.items():
            own += total[np.clip(end - reach, begin, len(total) - 1)] - total[np.minimum(begin, len(total) - 1)]
        np.maximum(best, own / _norm(size), out=best)
    return best


def cut_windows(block: Sentences, places: np.ndarray) -> np.ndarray:
    """The code points of a window of the largest size at each place; 0 beyond the sentence."""
    size = WINDOWS[-1]
    stop = block.stop[np.searchsorted(block.start, places, "right") - 1]
    at = places[:, None] + np.arange(size)
    return np.where(at < stop[:, None], block.codes[np.minimum(at, len(block.codes) - 1)], 0).astype(np.uint32)


def embed(windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and normalised weights of the subsequences of each window's first ``sizes`` places."""
    codes = windows.astype(np.uint64)
    inside = (np.arange(windows.shape[1]) < sizes[:, None]) & (windows > 0)
    norms = np.array([_norm(s) for s in sizes])
    buckets, weights = [], []
    for c in _CHOICES:
        count = windows.shape[1] - c[-1]
        buckets.append((sum(codes[:, c[k] : c[k] + count] * _MULT[k] for k in range(LENGTH)) >> U64(64 - BUCKET_BITS)).astype(np.int64))
        whole = np.logical_and.reduce([inside[:, p : p + count] for p in c])
        weights.append(whole * (DECAY ** (c[-1] + 1) / norms[:, None]))
    return np.concatenate(buckets, axis=1), np.concatenate(weights, axis=1)


def kernel(windows: tuple[np.ndarray, np.ndarray], landmarks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Kernel values of embedded windows and landmarks."""
    out = np.empty((len(windows[0]), len(landmarks[0])))
    table = np.zeros(1 << BUCKET_BITS)
    for l, (b, w) in enumerate(zip(*landmarks)):
        np.add.at(table, b, w)
        out[:, l] = (table[windows[0]] * windows[1]).sum(axis=1)
        table[b] = 0
    return out


def best_windows(block: Sentences, table: np.ndarray, most: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of the best window of each of the ``most`` best sentences of every text."""
    if not len(block.start):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    value = place_scores(block, table)
    peak = np.maximum.reduceat(value, block.start)
    order = np.lexsort((block.start, -peak, block.text))
    text = block.text[order]
    first = np.searchsorted(text, text)
    chosen = order[np.arange(len(order)) - first < most]
    sentence = np.repeat(np.arange(len(block.start)), np.diff(np.append(block.start, len(value))))
    hits = np.flatnonzero(value == peak[sentence])
    places = hits[np.searchsorted(sentence[hits], chosen)]
    return block.text[chosen], places, peak[chosen]


def _best_size(windows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The size of each window whose value is largest."""
    values = []
    for size in WINDOWS:
        b, w = embed(windows, np.full(len(windows), size))
        values.append((table[b] * w).sum(axis=1))
    return np.array(WINDOWS)[np.argmax(values, axis=0)]


def _fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Squared-hinge SVM with a constant column: Newton steps over the rows inside the margin, halved while the loss grows."""
    x = np.column_stack([x, np.ones(len(x))])
    shrink = ridge * np.append(np.ones(x.shape[1] - 1), 1e-6)
    loss = lambda w: (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + 0.5 * (shrink * w * w).sum()
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        inside = y * (x @ w) < 1
        xa, ya, wa = x[inside], y[inside], weight[inside]
        grad = -2 * xa.T @ (wa * ya * (1 - ya * (xa @ w))) + shrink * w
        step = np.linalg.solve(2 * (xa * wa[:, None]).T @ xa + np.diag(shrink), grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        now, before = loss(w), now
        if before - now < 1e-9:
            break
    return w


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * len(y) * np.append(w[:-1], 0)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def _runs(texts: list[str], size: int = 300_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _witness(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """The scaled difference of the classes' mean embeddings: for each bucket the standard score of its share of toxic documents above that of clean ones."""
    held = np.zeros((2, 1 << BUCKET_BITS))
    for a, b in _runs(texts):
        block = Sentences(texts[a:b])
        text = np.repeat(block.text, np.diff(np.append(block.start, len(block.codes)))) << BUCKET_BITS if len(block.start) else block.text
        pairs = np.unique(np.concatenate([bucket | text[: len(bucket)] for _, bucket in _buckets(block.codes)]))
        np.add.at(held, (toxic[a:b][pairs >> BUCKET_BITS], pairs & ((1 << BUCKET_BITS) - 1)), 1)
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    share = held.sum(axis=0) / n.sum()
    spread = np.sqrt(np.maximum(share * (1 - share), 1 / n.sum()) * (1 / n[0] + 1 / n[1]))
    return np.maximum((held[1] / n[1] - held[0] / n[0]) / spread - 2, 0)


def _collect(texts: list[str], which: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, window, value) of the best windows of the chosen documents."""
    out = []
    for a, b in _runs([texts[i] for i in which]):
        block = Sentences([texts[i] for i in which[a:b]])
        text, place, value = best_windows(block, table, most, b - a)
        if len(text):
            out.append((which[a:b][text], cut_windows(block, place), value))
    if not out:
        return np.empty(0, np.int64), np.empty((0, WINDOWS[-1]), np.uint32), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _diverse(embedded: tuple[np.ndarray, np.ndarray], most: int, like: float = 0.7) -> np.ndarray:
    """Up to ``most`` of the windows in their order, none of which is too like one before it."""
    chosen: list[int] = []
    table = np.zeros(1 << BUCKET_BITS)
    free = np.ones(len(embedded[0]), dtype=bool)
    while len(chosen) < most and free.any():
        i = int(np.argmax(free))
        chosen.append(i)
        np.add.at(table, embedded[0][i], embedded[1][i])
        free &= (table[embedded[0]] * embedded[1]).sum(axis=1) < like
        free[i] = False
        table[embedded[0][i]] = 0
    return np.array(chosen, dtype=np.int64)


def _disturbed(windows: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The windows with a space or a letter put into their inner half; the last place falls out of windows of the largest size."""
    out = windows.copy()
    for i, size in enumerate(sizes):
        at = int(rng.integers(size // 4 + 1, size - size // 4))
        out[i, at + 1 :] = windows[i, at:-1]
        out[i, at] = 32 if rng.integers(2) else 97 + int(rng.integers(26))
    return out, np.array([next((w for w in WINDOWS if w > size), WINDOWS[-1]) for size in sizes], dtype=np.int64)


def fit_machine(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(table, bias) of the machine over sentences of the documents ``texts``."""
    table = _witness(texts, toxic)
    bad, good = np.flatnonzero(toxic == 1), np.flatnonzero(toxic == 0)
    negatives: list[tuple[np.ndarray, np.ndarray]] = []
    bias, rng = 0.0, np.random.default_rng(1)
    for _ in range(ROUNDS):
        _, plus, value = _collect(texts, bad, table, POSITIVES)
        order = np.argsort(-value, kind="stable")
        plus = plus[order]
        _, minus, value = _collect(texts, good, table, NEGATIVES)
        order = np.argsort(-value, kind="stable")
        minus = minus[order]
        negatives.append((minus, _best_size(minus, table)))
        sizes = _best_size(plus, table)
        own, worn = embed(plus, sizes), embed(*_disturbed(plus, sizes, rng))
        others = embed(*(np.concatenate(x) for x in zip(*negatives)))
        hard = embed(*negatives[-1])
        picks = _diverse(own, LANDMARKS // 2), _diverse(hard, LANDMARKS // 2)
        landmarks = tuple(np.concatenate([own[k][picks[0]], hard[k][picks[1]]]) for k in range(2))
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
        solid = values > 1e-3
        root = vectors[:, solid] / np.sqrt(values[solid])
        x = np.concatenate([kernel(part, landmarks) for part in (own, worn, others)]) @ root
        counts = [len(own[0]), len(worn[0]), len(others[0])]
        y = np.repeat([1.0, 1.0, -1.0], counts)
        weight = np.repeat([total / max(1, c) for total, c in zip((1.0, DISTURBED_WEIGHT, NEGATIVE_WEIGHT), counts)], counts)
        w = _fit_linear(x, y, weight, RIDGE)
        table = np.bincount(landmarks[0].ravel(), weights=(landmarks[1] * (root @ w[:-1])[:, None]).ravel(), minlength=1 << BUCKET_BITS)
        bias = float(w[-1])
    return table, bias


class ToxicityModel:
    """The collapsed machine and the logistic model of a document; ``logistic`` is None without both labels in training."""

    def __init__(self, table: np.ndarray, bias: float, logistic: np.ndarray | None):
        self.places = np.flatnonzero(table)
        self.weights, self.bias, self.logistic = table[self.places], bias, logistic
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_table": None}

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << BUCKET_BITS)
            self._table[self.places] = self.weights
        return self._table

    @classmethod
    def train(cls, texts: list[str], toxic: list[int]) -> ToxicityModel:
        """Learn from documents, each a text of sentences, and their labels."""
        labels = np.array(toxic, dtype=np.int64)
        if len(set(toxic)) < 2:
            return cls(np.zeros(1 << BUCKET_BITS), 0.0, None)
        model = cls(*fit_machine(texts, labels), None)
        model.logistic = _fit_logistic(model.features(texts), labels.astype(float))
        return model

    def features(self, texts: list[str]) -> np.ndarray:
        """The best decision of a window, the logarithms of the mass of toxic places and of all places, of each text."""
        best, mass, places = np.full(len(texts), -3.0), np.zeros(len(texts)), np.zeros(len(texts))
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for piece in _pieces(t):
                pieces.append(piece)
                owner.append(i)
        for a, b in _runs(pieces):
            block = Sentences(pieces[a:b])
            if not len(block.start):
                continue
            value = place_scores(block, self.table) + self.bias
            text = np.array(owner[a:b])[block.text]
            np.maximum.at(best, text, np.maximum.reduceat(value, block.start))
            np.add.at(mass, text, np.add.reduceat(np.clip(value - TOXIC_FROM, 0, 1), block.start))
            np.add.at(places, text, np.diff(np.append(block.start, len(value))))
        return np.column_stack([best, np.log1p(mass), np.log1p(places)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(len(texts))
        z = self.features([t or "" for t in texts]) @ self.logistic[:-1] + self.logistic[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``_PIECE`` characters, cut after a line end or else a space where there is one."""
    at = 0
    while len(text) - at > _PIECE:
        stop = text.rfind("\n", at, at + _PIECE)
        if stop <= at:
            stop = text.rfind(" ", at, at + _PIECE)
        stop = stop + 1 if stop > at else at + _PIECE
        yield text[at:stop]
        at = stop
    yield text[at:]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _sample_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bounded part of each document: the sentences with the smallest hashes, in order of their places. Of a long sentence the part with the smallest hash is taken."""
    for batch in batches:
        texts = []
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            own = [min(_PARTS.findall(s), key=_hash) for s in re.split(r"(?<=[.!?])\s|\n", text.as_py()) if s.strip()]
            own = [s for k, s in enumerate(own) if k == 0 or s != own[k - 1]]
            most = SENTENCES_TOXIC if label else SENTENCES_CLEAN
            if len(own) > most:
                kept = sorted(sorted(range(len(own)), key=lambda k: (_hash(own[k]), k))[:most])
                own = [own[k] for k in kept]
            texts.append("\n".join(own))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(texts, pa.string())], names=["doc_id", "label", "text"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "toxic") -> ToxicityModel:
    """Learn from sentences of the labelled documents that meet ``training`` (over doc_id), a bounded sample of each label: of ids, and of the rows with these ids."""
    known = labels.where(training & F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("label"))
    chosen = bounded_sample(known.where("label = 1"), "doc_id", "label", SAMPLE_TOXIC).union(bounded_sample(known.where("label = 0"), "doc_id", "label", SAMPLE_CLEAN))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = bounded_rows(rows.where("label = 1"), SAMPLE_TOXIC).union(bounded_rows(rows.where("label = 0"), SAMPLE_CLEAN))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_sample_sentences, f"doc_id {kind}, label int, text string").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    return ToxicityModel.train(found["text"].to_pylist(), found["label"].to_pylist())


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for _, texts in text_blocks(batch, "text"):
                scores += shared.value.scores([(t or b"").decode("utf-8") for t in texts]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
