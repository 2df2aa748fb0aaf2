"""Token ids where texts hold added tokens, and where pieces share a hash."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gramloom.llm import tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_have_their_ids(path):
    library = Tokenizer.from_file(path)
    r = random.Random(2)
    bits = ["a", " ", "b", "\n", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "word", "é"]
    texts = ["a <|endoftext|> b", *("".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(1500))]
    got = tokens.TokenIds(path).ids(texts)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [4, 10, 16])
@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_that_share_a_hash(path, bits, monkeypatch):
    monkeypatch.setattr(tokens.TokenIds, "mask", np.uint64(2**bits - 1))
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 3000)
    r = random.Random(bits)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 5)))
    texts = [" ".join(word() for _ in range(r.randint(1, 30))) for _ in range(300)]
    library = Tokenizer.from_file(path)
    got = tokens.TokenIds(path).ids(texts)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
