"""Document quality by attention-based multiple-instance learning.

Method
------
A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is described by its content, the counts of its words and pairs of
words in ``CONTENT`` hashed places, and by its surface, shares of characters and tokens (capitals, digits, symbols, table bars, repeated and distinct
words, lengths); a learned layer encodes both, h = tanh(W x + b). Gated
attention gives each passage a weight, a ~ exp(w . (tanh(V h) * sigmoid(U h))), normalised over the document, and the document's
score is the sigmoid of a linear function of the weighted sum of h. All parts are learned together from document labels only,
on a bounded sample, by full-batch Adam; the executors send the sample's descriptions, not its texts, with at most ``SAMPLE_PASSAGES`` passages of a document,
evenly spaced. Scores read all passages.

Defined results: null and empty texts, and texts without words, are one passage of zeros. Without both labels in training the
score is the share of label 1 (0.5 without labels). Repeated rows are scored each, and trained each if labelled. A long text is described in pieces
of whole passages, with the same result. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_rows, bounded_sample
from .shingles import U64, mix, text_blocks, word_hashes

PASSAGE_WORDS = 64
HIDDEN, ATTENTION = 16, 8
EPOCHS, RATE, RIDGE = 250, 0.02, 1e-4
#: The bounded training sample: labelled documents, chosen by a hash of doc_id.
SAMPLE_DOCS, SAMPLE_PASSAGES = 2_000, 64
#: Hashed places of words and pairs of words, and the ridge of their weights.
CONTENT, CONTENT_RIDGE = 96, 3e-3
#: Bytes from which on a text is described in pieces.
_PIECE = 1 << 20

_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BYTES = np.arange(256)
_CLASSES = {
    "chars": (_BYTES & 0xC0) != 0x80,
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "bar": _BYTES == ord("|"),
    "bang": np.isin(_BYTES, [ord(c) for c in "!?"]),
    "symbol": np.isin(_BYTES, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]),
    "stop": np.isin(_BYTES, [ord(c) for c in ".,;:"]),
    "quote": np.isin(_BYTES, [ord(c) for c in "\"'()-"]),
}
SURFACE = 18
N_FEATURES = SURFACE + CONTENT


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut before the first word of a passage, about every ``_PIECE`` bytes."""
    if len(text) <= 2 * _PIECE:
        yield text
        return
    words, begin, before = 0, 0, True
    for at in range(0, len(text), _PIECE):
        space = _SPACE[np.frombuffer(text, dtype=np.uint8, count=min(_PIECE, len(text) - at), offset=at)]
        starts = np.flatnonzero(~space & np.append(before, space[:-1]))
        before = bool(space[-1])
        first = -words % PASSAGE_WORDS
        words += len(starts)
        cut = at + int(starts[first]) if first < len(starts) else 0
        if cut - begin >= _PIECE:
            yield text[begin:cut]
            begin = cut
    yield text[begin:]


def describe(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages in order, and the number of passages of each text (at least one)."""
    rows, counts = [], np.zeros(len(texts), dtype=np.int64)
    block, owner = [], []

    def flush() -> None:
        if block:
            x, passages = _describe(block)
            rows.append(x)
            np.add.at(counts, owner, passages)
            block.clear()
            owner.clear()

    for i, text in enumerate(texts):
        for piece in _pieces(text or b""):
            if sum(map(len, block)) + len(piece) > 2 * _PIECE:
                flush()
            block.append(piece)
            owner.append(i)
    flush()
    return (np.concatenate(rows) if rows else np.zeros((0, N_FEATURES), np.float32)), counts


def _describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t or b"" for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    hashes, offsets = word_hashes(parts)
    counts = np.diff(offsets)
    passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    out = np.zeros((passages.sum(), N_FEATURES), dtype=np.float32)
    if not len(hashes):
        return out, passages
    edge = np.diff((~_SPACE[data]).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.repeat(np.arange(len(parts)), counts)
    place = np.arange(len(hashes)) - offsets[text]
    passage = (np.cumsum(passages) - passages)[text] + place // PASSAGE_WORDS
    total = len(out)
    per_token = {}
    for name, members in _CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(members[data], dtype=np.int64)])
        per_token[name] = sums[ends] - sums[starts]
    accented = np.zeros(len(data), dtype=np.int64)  # capitals of two bytes
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    sums = np.concatenate([[0], np.cumsum(accented)])
    per_token["upper"] = per_token["upper"] + sums[ends] - sums[starts]
    sum_of = lambda values: np.bincount(passage, weights=values, minlength=total)
    chars_of = per_token["chars"]
    words, chars = sum_of(np.ones(len(passage))), sum_of(chars_of)
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][fresh], minlength=total)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    after = np.minimum(ends, len(data) - 1)
    odd = per_token["symbol"] + per_token["bang"] + per_token["bar"]
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    out[:, 0] = np.log1p(words)
    out[:, 1] = chars / w
    for k, name in enumerate(("upper", "digit", "bang", "symbol", "quote"), 2):
        out[:, k] = sum_of(per_token[name]) / c
    out[:, 7] = sum_of(per_token["bar"]) / w
    out[:, 8] = sum_of(per_token["stop"]) / w
    out[:, 9] = distinct / w
    out[:, 10] = sum_of(again) / w
    out[:, 11] = sum_of(odd > 0) / w
    out[:, 12] = sum_of((per_token["upper"] > 1) & (per_token["upper"] * 2 > chars_of)) / w
    out[:, 13] = sum_of(breaks[after + 1] - breaks[after]) / w
    out[:, 14] = sum_of(chars_of == 1) / w
    out[:, 15] = np.sqrt(np.maximum(0, sum_of(chars_of**2) / w - (chars / w) ** 2))
    out[:, 16] = sum_of(chars_of > 16) / w
    out[:, 17] = words > 0
    # content: half of the places hold words, half pairs of words, with the root of their counts
    half = CONTENT // 2
    pairs = mix(hashes[:-1] * U64(3) + hashes[1:])[passage[1:] == passage[:-1]] if len(hashes) > 1 else hashes[:0]
    for k, (values, of) in enumerate(((hashes, passage), (pairs, passage[1:][passage[1:] == passage[:-1]]))):
        place = of * half + (values % U64(half)).astype(np.int64)
        out[:, SURFACE + k * half : SURFACE + (k + 1) * half] = np.sqrt(np.bincount(place, minlength=total * half).reshape(total, half))
    return out, passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class QualityModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray] | None, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    @staticmethod
    def _forward(x: np.ndarray, first: np.ndarray, bag: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        logit = (t * s) @ p["w"]
        e = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    @classmethod
    def train(cls, texts: list[bytes | None], labels: list[int]) -> QualityModel:
        """Learn from whole texts and their labels."""
        return cls.train_described(*describe(texts), labels)

    @classmethod
    def train_described(cls, x: np.ndarray, passages: np.ndarray, labels: list[int]) -> QualityModel:
        y = np.array(labels, dtype=float)
        prior = float(y.mean()) if len(y) else 0.5
        if len(set(labels)) < 2:
            return cls(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, prior)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.clip((x - mean) / scale, -8, 8).astype(np.float32)
        first = np.cumsum(passages) - passages
        bag = np.repeat(np.arange(len(passages)), passages)
        rng = np.random.default_rng(3)
        shapes = {"W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "d": ()}
        p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if s else np.float64(np.log(prior / (1 - prior))) for k, s in shapes.items()}
        p["W"][SURFACE:] *= 0.1
        ridge = {k: RIDGE for k in p}
        ridge["W"] = np.repeat([RIDGE, CONTENT_RIDGE], [SURFACE, CONTENT])[:, None]
        m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
        for step in range(1, EPOCHS + 1):
            f = cls._forward(x, first, bag, p)
            dy = (f["y"] - y) / len(y)
            dz = dy[:, None] * p["c"]
            dh = f["a"][:, None] * dz[bag]
            da = (f["h"] * dz[bag]).sum(axis=1)
            dlogit = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[bag])
            gate = dlogit[:, None] * p["w"]
            dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
            dh += dt @ p["V"].T + ds @ p["U"].T
            dx = dh * (1 - f["h"] ** 2)
            g = {"W": x.T @ dx, "b": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ dlogit, "c": f["z"].T @ dy, "d": dy.sum()}
            for k in p:
                grad = g[k] + ridge[k] * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(mean, scale, p, prior)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x, passages = describe(texts)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return self._forward(x, np.cumsum(passages) - passages, np.repeat(np.arange(len(passages)), passages), self.weights)["y"]


def fit_quality(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "quality") -> QualityModel:
    """Learn from a bounded sample of the labelled documents that meet ``training`` (over doc_id): of ids, and of the rows with these ids."""
    known = labels.where(training & F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).alias("label"))
    chosen = bounded_sample(known.withColumn("all", F.lit(True)), "doc_id", "all", SAMPLE_DOCS).drop("all")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    rows = bounded_rows(rows, SAMPLE_DOCS)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_describe_sample, f"doc_id {kind}, label int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("x", "ascending")])
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in found["x"].to_pylist()]
    x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
    return QualityModel.train_described(x, np.array([len(b) for b in bags], dtype=np.int64), found["label"].to_pylist())


def _describe_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_blocks(batch, "text"):
            x, passages = describe(texts)
            bags = [b[np.linspace(0, len(b) - 1, min(len(b), SAMPLE_PASSAGES)).round().astype(int)].tobytes() for b in np.split(x, np.cumsum(passages)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), batch.column("label").slice(start, len(texts)), pa.array(bags, pa.binary())], names=["doc_id", "label", "x"])


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(texts) for _, texts in text_blocks(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else np.empty(0))], names=["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
