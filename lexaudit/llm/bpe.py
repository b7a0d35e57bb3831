"""BPE encoding and decoding by a prefix-sharing trie traversal.

Method
------
The encoding of every prefix of a word ends in exactly one token, and a token sequence is an encoding if and only if each
neighbouring pair is. So a trie node (a prefix) needs a single value, its last token: the token t ending there for
which the node t starts after has a last token p such that (p, t) stand side by side in BPE. The distinct words of
a block that are not cached are walked in sorted order, which is the depth-first order of their trie; the states on
the path shared with the previous word are kept, so a shared prefix is computed once.

Two tokens stand side by side if no merge across their border comes up: merges happen in the order of their ranks, so
the right spine of p and the left spine of t are compared over the times at which their parts exist.

The tokenizer file gives NFC, lower-casing, a splitting pattern, a byte-level alphabet, and a mark on the last symbol
of a word. Its special tokens are found in the raw text first. Decoding joins the tokens' strings by spaces, which
is what a file without a decoder asks for.

Defined results: a null text is empty; an empty text gives no ids and an empty decoded text. Ids are packed as
little-endian unsigned 32-bit integers. Null ids are kept, and repeated rows are each encoded. A very long text is encoded whole, word by word. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import text_blocks

#: Cached words of a Python worker: two generations of so many.
CACHE_WORDS = 200_000
#: The tokenizer file is sent to the executors; a larger one is refused.
MAX_FILE_BYTES = 64_000_000
END = "</w>"
_NEVER = 1 << 60
_ONE = (1,)
# Code points that Unicode 16 added, which the library knows and this Python's tables may not: letters, numbers, and
# (first, last, distance) of the lower case of capitals, of which the library also knows those of Unicode 17.
_ADDED = {
    r"\p{L}": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
        (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ),
    r"\p{N}": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}
_LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
_LOWER_MAP = {c: c + d for first, last, d in _LOWER for c in range(first, last + 1)}
_BEYOND_LATIN = re.compile("[^\x00-\u024f]").search


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def _latin(pattern: str) -> re.Pattern[str]:
    """The splitting pattern for texts below U+0250, with its classes written out."""
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        own = regex.compile(name)
        pattern = pattern.replace(name, "".join(re.escape(chr(c)) for c in range(0x250) if own.match(chr(c))))
    return re.compile(pattern)


@functools.cache
def _stand_ins() -> dict[int, int]:
    """A code point of the right class for each one that this Python's regex module puts in another class than Unicode 16 does."""
    beyond = [c for c in range(0x250, 0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, beyond))
    old = {c for c in beyond if unicodedata.category(chr(c)) == "Cn"}
    out: dict[int, int] = {}
    for name, ranges in _ADDED.items():
        added = {c for first, last in ranges for c in range(first, last + 1)}
        known = {ord(c) for c in regex.findall(name, every)}
        out.update(dict.fromkeys((known & old) - added, ord("#")))
        out.update(dict.fromkeys(added - known, ord("a") if "L" in name else ord("1")))
    return out


def _wide(pattern: str) -> Callable[[str], list[str]]:
    """Splits any text, with the classes of Unicode 16 whatever the versions of this Python and of its regex module are."""
    own, stand_ins = regex.compile(pattern), _stand_ins()
    odd = re.compile("[" + "".join(map(chr, sorted(stand_ins))) + "]").search if stand_ins else lambda text: None

    def split(text: str) -> list[str]:
        if not odd(text):
            return own.findall(text)
        return [text[m.start() : m.end()] for m in own.finditer(text.translate(stand_ins))]

    return split


class TrieEncoder:
    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = pattern
        self.latin_pieces = _latin(pattern).findall
        self._wide_pieces = None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.mark = model["end_of_word_suffix"] or ""
        self.chars = byte_alphabet()
        vocab = self.vocab
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[vocab[a], vocab[b]] = r
            self.parts[vocab[a + b]] = (vocab[a], vocab[b], r)
        #: The lengths of the tokens that end in these two symbols, longest first, with 1; the mark belongs to the last of them.
        lengths: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
        for t in vocab:
            ends = self.mark and t.endswith(self.mark) and len(t) > len(self.mark)
            body = t[: -len(self.mark)] if ends else t
            if len(body) > 1:
                lengths[bool(ends)].setdefault(body[-2:], {1}).add(len(body))
        self.reach, self.end_reach = ({k: tuple(sorted(v, reverse=True)) for k, v in x.items()} for x in lengths)
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def forget(self) -> None:
        """Drop the cached words and pairs."""
        self.young, self.old, self.beside = {}, {}, {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank at which it is merged away) along one edge of a token, from its outermost symbol to the token itself."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until = self.parts[token][2]
            token = self.parts[token][side]

    def _clash(self, p: int, t: int, below: int) -> bool:
        """Whether a merge across the border of p and t comes up before rank ``below``."""
        xs = self.right.get(p) or self.right.setdefault(p, self._spine(p, 1))
        ys = self.left.get(t) or self.left.setdefault(t, self._spine(t, 0))
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = xs[i], ys[j]
            r = self.rank.get((x, y), _NEVER)
            if r < below and r < x_until and r <= y_until:
                return True
            if x_until == y_until == _NEVER:
                return False
            if x_until <= y_until:
                i += 1
                if x_until == y_until:
                    j += 1
            else:
                j += 1

    def _is_whole(self, token: int) -> bool:
        """Whether BPE makes this token of its own symbols."""
        known = self.whole.get(token)
        if known is None:
            made = self.parts.get(token)
            known = self.whole[token] = made is None or (self._is_whole(made[0]) and self._is_whole(made[1]) and not self._clash(made[0], made[1], made[2]))
        return known

    def _last(self, word: str, i: int, states: list[tuple[int, int]], end: str) -> tuple[int, int]:
        """(token, its symbols): the last token of the encoding of word[: i + 1]."""
        vocab, beside = self.vocab, self.beside
        for n in (self.end_reach if end else self.reach).get(word[i - 1 : i + 1], _ONE) if i else _ONE:
            if n > i + 1:
                continue
            t = vocab.get(word[i - n + 1 : i + 1] + end)
            if t is None:
                continue
            whole = self.whole.get(t)
            if not (self._is_whole(t) if whole is None else whole):
                continue
            if n > i:
                return t, n
            pair = (states[i - n][0], t)
            fits = beside.get(pair)
            if fits is None:
                fits = beside[pair] = not self._clash(*pair, _NEVER)
            if fits:
                return t, n
        raise ValueError(f"no token ends {word[: i + 1]!r}")

    def _learn(self, words: list[str]) -> None:
        """Encode new distinct words; sorted, they are the depth-first order of their trie."""
        chars, names, path, states = self.chars, self.names, "", []
        for word, mapped in sorted(((w, "".join([chars[b] for b in w.encode("utf-8", "surrogatepass")])) for w in words), key=lambda x: x[1]):
            keep, most = 0, min(len(states), len(mapped) - 1)
            while keep < most and path[keep] == mapped[keep]:
                keep += 1
            del states[keep:]
            path = mapped
            for i in range(keep, len(mapped) - 1):
                states.append(self._last(mapped, i, states, ""))
            ids, at = [], len(mapped) - 1
            token, n = self._last(mapped, at, states, self.mark)
            while True:
                ids.append(token)
                at -= n
                if at < 0:
                    break
                token, n = states[at]
            ids.reverse()
            self.young[word] = (np.array(ids, dtype="<u4").tobytes(), " ".join([names[t] for t in ids]))

    def _pieces(self, part: str) -> list[str]:
        if part.isascii():
            return self.latin_pieces(part.lower())
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        if not _BEYOND_LATIN(part):
            return self.latin_pieces(part)
        part = part.translate(_LOWER_MAP)
        if self._wide_pieces is None:
            self._wide_pieces = _wide(self.pattern)
        return self._wide_pieces(part)

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Packed ids and decoded text of each text."""
        if len(self.beside) > 4 * CACHE_WORDS:
            self.beside.clear()
        split = []
        for text in texts:
            parts = self.cut(text) if "<|" in text else [text]
            words: list[str | int] = []
            for k, part in enumerate(parts):
                if k % 2:
                    words.append(self.special[part])
                elif part:
                    words += self._pieces(part)
            split.append(words)
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        new = []
        for w in set().union(*split):
            if w not in self.young:
                if w in self.old:
                    self.young[w] = self.old[w]
                elif isinstance(w, int):
                    self.young[w] = (np.array([w], dtype="<u4").tobytes(), self.names[w])
                else:
                    new.append(w)
        self._learn(new)
        get = self.young.__getitem__
        out = []
        for words in split:
            both = [get(w) for w in words]
            out.append((b"".join([x for x, _ in both]), " ".join([y for _, y in both])))
        return out


_LOADED: dict[int, TrieEncoder] = {}


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = shared.value
        key = hash(file)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = TrieEncoder(file)
        encoder = _LOADED[key]
        try:
            for batch in batches:
                for start, texts in text_blocks(batch, "text", 1_000_000):
                    found = encoder.encode([(t or b"").decode("utf-8") for t in texts])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.string())], names=["doc_id", "ids", "decoded"])
        finally:
            encoder.forget()  # the worker may next serve an operator that needs the memory

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary, little-endian unsigned 32-bit integers), decoded."""
    with open(tokenizer_path, "rb") as f:
        file = f.read(MAX_FILE_BYTES + 1)
    if len(file) > MAX_FILE_BYTES:
        raise ValueError(f"the tokenizer file is larger than {MAX_FILE_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(file)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_encoder(shared), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
