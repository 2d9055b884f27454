"""Piecewise encoding against encoding whole texts."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkclust.llm.encoding import Encoder

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TOKS = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}
ENCODERS = {n: Encoder(public_tokenizers.path(n)) for n in NAMES}
PARTS = st.sampled_from(
    [" ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x85", " ", " ", "　", "the", "The", "thing,", "end.", "don't", "'s", "é", "é", "́", "İ", "ß", "ΑΣ", "12", "3.14", "<|endoftext|>", "!!", "...", "a,b", "😀", "漢字", "\x00", "–", "naïve.", "x" * 50]
)


def same(name, texts):
    flat, counts = ENCODERS[name].encode([t.encode() for t in texts])
    cuts = np.split(flat, np.cumsum(counts)[:-1])
    assert [c.tolist() for c in cuts] == [TOKS[name].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(PARTS, max_size=12).map("".join), min_size=1, max_size=4))
def test_pieces_give_the_ids_of_the_whole(name, texts):
    same(name, texts)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(max_size=40), min_size=1, max_size=3))
def test_any_text(name, texts):
    same(name, texts)


@pytest.mark.parametrize("name", NAMES)
def test_long_pieces_and_a_full_memory(name):
    same(name, ["word " * 3 + "y" * 9000 + " word.", "", "word word."])
    e = Encoder(public_tokenizers.path(name), max_bytes=100)
    for _ in range(3):
        for t in ("one two three four five.", "six, seven, one."):
            assert e.encode([t.encode()])[0].tolist() == TOKS[name].encode(t, add_special_tokens=False).ids
