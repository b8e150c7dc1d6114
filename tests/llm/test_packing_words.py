"""The word encoder against the library where composing or lower-casing changes what stands before a closing mark."""

import random
import unicodedata

import public_tokenizers
import pytest

from quillspan.llm import packing


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_every_letter_and_digit_before_a_mark(encoder):
    letters = [chr(c) for c in range(0x110000) if chr(c).isalnum()]
    texts = [f"{'x' if i % 2 else ''}{c}{'.,;:!?'[i % 6]}{' b' if i % 3 else ''}" for i, c in enumerate(letters)]
    texts += [f"{a}{c}{m}{b}" for c in sorted(packing.UNSTABLE) for m in ".,;:!?" for a in ("", "ab", "A ") for b in ("", " ", " cd")]
    assert encoder.encode(texts) == encoder.library(texts)


def test_no_letter_is_left_out():
    assert "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not unicodedata.normalize("NFC", c).lower()[-1].isalnum()) == "".join(sorted(packing.UNSTABLE))


def test_awkward_strings(encoder):
    rng = random.Random(7)
    pool = "İ.,;:!? aZé́क़יִΣςͅßẞ한ﬁŉǰ0²½<|>_'sn\t\n" + "".join(packing.UNSTABLE)
    texts = [". a", "? ", "a. ", "..  "] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(40_000)] + ["İ.", "İSTANBULİ, ankara", "क़.", "יִ."]
    assert encoder.encode(texts) == encoder.library(texts)
