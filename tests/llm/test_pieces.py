import random
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import pieces
from tilewright.llm.queries import piece_model

from .rows import LONG, collected, documents, empty

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=piece_model())
MODEL = pieces.load(piece_model())


def ids(texts):
    return [x.tolist() for x in pieces.Encoder(MODEL).encode(texts)]


HARD = ["", " ", "  a", "a\n\tb  ", "▁a", "\x00x", "é𝒳 漢", "<s> </s> <0x41>", " " * 100 + "x" + " " * 37 + "漢" + " " * 16, "a" * 1000, "ab" * 500, "=-" * 300 + "  " + "=" * 77, "▁▁▁ ▁", *(" " * n for n in range(1, 70)), LONG]


def test_hard_texts():
    want = LIBRARY.encode(HARD, add_bos=True, add_eos=True, num_threads=1)
    assert ids(HARD) == want
    assert [MODEL.decode_bytes(np.array(x)).decode() for x in want] == [LIBRARY.decode(x) for x in want]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("etaoin shr  ▁-=0\n", max_size=200))
def test_any_text(text):
    text = text.encode(errors="ignore").decode()
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert ids([text])[0] == want
    assert MODEL.decode_bytes(np.array(want)).decode() == LIBRARY.decode(want)


def test_decode_any_ids():
    rng = random.Random(5)
    for _ in range(500):
        own = [rng.choice([0, 1, 2, 200, 173, 259, 260, 28705, rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randrange(12))]
        assert MODEL.decode_bytes(np.array(own, np.int64)).decode() == LIBRARY.decode(own)
    with pytest.raises(ValueError):
        MODEL.decode_bytes(np.array([MODEL.n]))


def test_documents(spark):
    got = pieces.encode_documents(documents(spark), piece_model(), with_ids=True).collect()
    assert len(got) == 12
    for r in got:
        assert r.n_tokens == len(r.ids)
    by = {r.doc_id: r for r in got}
    assert by[3].ids == by[4].ids == [1, 2] and by[3].decoded == ""
    assert by[6].ids == LIBRARY.encode(LONG, add_bos=True, add_eos=True) and by[6].decoded == LONG
    assert collected(pieces.encode_documents(empty(spark), piece_model()), "doc_id") == []


def test_long_unbroken_words():
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for n in (pieces.LONG - 1, pieces.LONG, pieces.LONG + 1, 30_000):
        hard = ["".join(rng.choice(letters) for _ in range(n)), "".join(rng.choice("ab漢é\x00") for _ in range(n)), "a" * n, "the" * (n // 3) + " " + "=-" * n, "x " + " " * n + "ing" * n]
        assert ids(hard) == LIBRARY.encode(hard, add_bos=True, add_eos=True, num_threads=1)


def test_a_megabyte_without_a_space():
    rng = random.Random(10)
    text = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 20))
    began = time.process_time()
    got = ids([text])
    assert time.process_time() - began < 30
    assert got == LIBRARY.encode([text], add_bos=True, add_eos=True)


def test_models_that_normalise_are_refused(tmp_path):
    with open(piece_model(), "rb") as f:
        model = f.read()
    own = b"\x1a" + bytes([len(b"\x18\x01\x20\x01")]) + b"\x18\x01\x20\x01"  # a later normaliser that removes spaces
    path = tmp_path / "other.model"
    path.write_bytes(model + own)
    with pytest.raises(ValueError):
        pieces.Pieces(str(path))
