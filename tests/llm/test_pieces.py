"""Long words against the tokenizer library."""

import base64
import random
import time

import public_tokenizers
import pytest
import sentencepiece

from quill.llm import pieces, queries


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))


def encoder():
    return pieces.Encoder(pieces.PieceModel(queries.piece_model()))


def check(lib, enc, texts):
    for t, (n, ids, text) in zip(texts, enc.texts(texts), strict=True):
        want = lib.encode(t)
        assert (n, ids, text) == (len(want), ",".join(map(str, want)), lib.decode(want)), t[:80]


RUN = 1_000_000
LONG = {
    "blanks": lambda r: " " * RUN, "hashes": lambda r: "#" * RUN, "equal signs": lambda r: "=" * RUN,
    "base64": lambda r: base64.b64encode(r.randbytes(RUN * 3 // 4)).decode(),
    "cjk": lambda r: "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(RUN)),
    "letters": lambda r: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RUN)),
    "a pattern": lambda r: "er=-" * (RUN // 4)}


@pytest.mark.parametrize("name", list(LONG))
def test_a_million_characters_without_a_blank(lib, name):
    text, enc = LONG[name](random.Random(1)), encoder()
    began = time.process_time()
    got = list(enc.texts([text]))
    assert time.process_time() - began < 15
    want = lib.encode(text)
    assert got == [(len(want), ",".join(map(str, want)), lib.decode(want))]


@pytest.mark.parametrize("window, overlap", [(24, 8), (40, 20), (pieces.WINDOW, pieces.OVERLAP)])
def test_windows_of_any_size(lib, monkeypatch, window, overlap):
    monkeypatch.setattr(pieces, "WINDOW", window)
    monkeypatch.setattr(pieces, "OVERLAP", overlap)
    enc, r = encoder(), random.Random(window)
    bits = ["a", "e", "th", "ing", "=", "==", "-", "#", "##", "0", "é", "漢", "翿", "😀", "ar", "ra", "aa", "xx", "."]
    texts = []
    for _ in range(300):
        some = r.sample(bits, r.randint(1, 6))
        texts.append("".join(r.choice(some) * r.choice([1, 1, 2, 30]) for _ in range(r.randint(1, 60))))
    texts += ["#" * n for n in range(window - 3, window * 5, 7)] + [" " * n + "x" + "=" * n for n in range(1, window * 4, 11)]
    check(lib, enc, texts)


def test_unknown_characters_beyond_the_vocabulary(lib):
    check(lib, encoder(), ["翿", "a鿿b", "힣\U0010ffff", "紁 x紁", "\U000f0000" * 500])
