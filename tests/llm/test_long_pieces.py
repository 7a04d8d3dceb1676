"""Very long words and runs, against the library."""

import random

import public_tokenizers
import pytest

from loamworks.llm import piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    import sentencepiece

    return piece_codec.PieceCodec(piece_codec.read_model(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


random.seed(3)
LONG = ["ab" * 300_000, "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)), "词" * 200_000, " " * 300_000 + "x", "a" + "\n" * 300_000, "x一" * 100_000, "-" * 300_000]


@pytest.mark.parametrize("text", LONG)
def test_long_texts_are_encoded_as_the_library_does(pair, text):
    codec, library = pair
    parts = codec.rendered(text)
    ids = [int(v) for v in ",".join(p[0] for p in parts).split(",")]
    assert ids == library.encode(text)
    assert codec.decode(ids) == library.decode(ids)


def test_a_word_of_millions_of_letters(pair):
    word = "antidisestablishment" * 100_000
    assert sum(p[0].count(",") + 1 for p in pair[0].rendered(word)) > 100_000
