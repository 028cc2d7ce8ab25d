"""The encoder against the tokenizers library, and what it holds."""

from __future__ import annotations

import itertools

import numpy as np
import public_tokenizers
import pytest

from weft.llm import bpe

TEXTS = ["", "Hello world, it's 2024!  \n\tYes no", "a\0b \0\0 c\0", "<|endoftext|>x<|endoftext|><|endoftext|>", "日本語 \U0001f600\U0001f600 é", "z" * 700 + " é" * 300, "\0" * 600, "the the the", "中" * 100]


@pytest.mark.parametrize("ranked", [True, False])
def test_encodes_as_the_library(ranked):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    tree = bpe.TreeBPE(path)
    if not ranked:
        tree.fast = None
    for texts in (TEXTS, TEXTS[::-1], [], [""]):
        ids, cuts = tree.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(cuts.tolist())] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert tree.decode_all(ids, cuts).to_pylist() == texts


def test_bytes_that_are_no_text_are_replaced():
    tree = bpe.TreeBPE(public_tokenizers.path("byte_bpe_50k.json"))
    ids, _ = tree.encode_all(["ok\U0001f600"])
    assert tree.decode_all(ids[:-1], np.array([0, len(ids) - 1])).to_pylist() == [tree.decode(ids[:-1])]


def test_short_pieces_are_encoded_without_the_library_and_the_cache_is_bounded():
    tree = bpe.TreeBPE(public_tokenizers.path("byte_bpe_50k.json"), cache=100)
    for i in range(20):
        tree.encode_all([" ".join(f"w{i}x{j}" for j in range(50))])
        assert len(tree.number) < 500
    assert "model" not in vars(tree)  # loaded for long pieces only
    tree.encode_all(["y" * 1000])
    assert "model" in vars(tree)
