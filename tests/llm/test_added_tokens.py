"""Ids of texts that hold added tokens, against the tokenizers library as it is by default."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from loamworks.llm import packing

TEXTS = ["<|endoftext|>", "a<|endoftext|> b", "a <|endoftext|><|endoftext|>  b\n", "<|endoftext|", "<<|endoftext|>>", "", "plain text"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", TEXTS)
def test_added_tokens_are_one_id(library, text):
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        ours = packing.ByteEncoder(f.read())
    assert np.frombuffer(ours.encode_added(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


SPACES = [" ", "\n", "\t", "\r\n", " \n", "\xa0", "\u3000", "\x85"]


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return packing.ByteEncoder(f.read())


@pytest.mark.parametrize("space", SPACES)
@pytest.mark.parametrize("around", ["{}", "{}x", "a{}", "a{}x", "a {}\x1cx", "{}<|endoftext|>{}b", "b {}'s {}", "{}!{}1"])
def test_long_white_space(library, encoder, space, around):
    for n in (255, 256, 257, 1000):
        text = around.format(space * n, space * n)
        assert np.frombuffer(encoder.encode_added(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "\n" * 2_000_000, "a" + "\t " * 500_000, "b" * 400_000, "<|endoftext|>" * 50_000, "!?" * 200_000])
def test_very_long_texts(library, encoder, text):
    assert np.frombuffer(encoder.encode_added(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packed_pieces_have_the_librarys_ids(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048).collect()}
    assert got == {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(TEXTS)}
