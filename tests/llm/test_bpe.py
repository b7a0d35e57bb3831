import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexaudit.llm.bpe import TrieEncoder, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, "rb") as f:
    OWN = TrieEncoder(f.read())


def same(texts):
    got = OWN.encode(texts)
    for text, (ids, decoded), want in zip(texts, got, LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert decoded == LIBRARY.decode(want.ids, skip_special_tokens=False), text


def test_chosen_texts():
    same(["", "  ", "It's don't I'LL 3½ ²x ΑΣ ΣΑΣ. İstanbul ﬁ", "<|endoftext|>a<|startoftext|><|endoftext|", "<|ENDOFTEXT|> hi", "\x1c a\x85b c", "日本語 한국어 😀👍🏽", "a" * 3000 + "!" * 2000])


def test_all_code_points():
    """Every assigned code point, and some others, between letters, next to itself and next to other characters."""
    known = [c for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x17000 or 0x18C00 <= c < 0x20000 or c % 503 == 0)]
    for at in range(0, len(known), 20_000):
        same([" ".join("a{0}b{0}1{0} {0}!{0}{0}!".format(chr(c)) for c in known[i : i + 20]) for i in range(at, min(at + 20_000, len(known)), 20)])
        OWN.forget()


def test_random_texts():
    rng = random.Random(5)
    same(["".join(rng.choice("aabcdethinrs'  .!#12éÉßñΣσİı́\n\t日ﬀ🙂") for _ in range(rng.randint(1, 60))) for _ in range(1500)])


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_latin_texts(text):
    same([text])


def test_cache_generations():
    OWN.forget()
    same(["alpha beta gamma"])
    OWN.young, OWN.old = {}, OWN.young
    same(["gamma beta delta alpha"])


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "Hello there"), (3, "Hello there"), (4, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, b"x", "y") for i, t in rows], "doc_id long, text string, ids binary, decoded string")
    got = sorted((r.doc_id, bytes(r.ids), r.decoded) for r in encode_documents(docs, PATH).collect())
    want = LIBRARY.encode("Hello there", add_special_tokens=False)
    assert got[0] == (1, b"", "") and got[1] == (2, b"", "")
    assert got[2] == got[3] == (3, np.array(want.ids, "<u4").tobytes(), LIBRARY.decode(want.ids))
    assert len(got[4][1]) == 4 * 30_000
    assert encode_documents(docs.limit(0), PATH).count() == 0
