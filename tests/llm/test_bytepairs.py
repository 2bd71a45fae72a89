"""Ids of packing's encoder: worked out by its own tables, equal to the library's."""

import random

import numpy as np
import pytest

from framelake.llm import bytepairs
from tests_llm_helpers import model

ATOMS = ["the", "Hello", "é", "ñandú", " ", "  ", "\n", " \n", "\t", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2009", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\u180e", "\ufeff",
         "\u201cq\u201d", "«", "日本語", "'s", "'ll", "''t", "12", "²", "\u0663", "!!", "<|endoftext|>", "\x00", "\U0001f600", "e\u0301", "x" * 40, "z" * 23, "y" * 24, "Donaudampfschifffahrt", "\u01c5", "\u1c90"]


class NoLibrary:
    def __getattr__(self, name):
        raise AssertionError(f"the library was asked for {name}")


def test_common_words_are_encoded_without_the_library():
    tk = pytest.importorskip("tokenizers")
    path = model("byte_bpe_50k.json")
    texts = ["Never seen wordlikes, überaus ñandú. It's 12 of them!\n\nNext  line ", "", " ", "unentthion schlaft\tdgpklldm"]
    want = [x.ids for x in tk.Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    own = bytepairs.Encoder(path)
    own.split.library = NoLibrary()
    for _ in range(2):
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == want


@pytest.mark.parametrize("bits", [5, 21])
def test_ids_of_odd_texts_match_the_library(bits, monkeypatch):
    tk = pytest.importorskip("tokenizers")
    monkeypatch.setattr(bytepairs.Held, "BITS", bits)  # 5: most strings find no place
    path, rng = model("byte_bpe_50k.json"), random.Random(5)
    lib, own = tk.Tokenizer.from_file(path), bytepairs.Encoder(path)
    for _ in range(40):
        texts = ["".join(rng.choice(ATOMS) + " " * rng.randint(0, 1) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 30))]
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [x.ids for x in lib.encode_batch_fast(texts, add_special_tokens=False)]
        assert own.cache.count < 3 << bits - 2
    assert own.encode([]) == []


def test_other_files_are_left_to_the_library():
    tk = pytest.importorskip("tokenizers")
    path = model("word_bpe_49k.json")
    lib, own = tk.Tokenizer.from_file(path), bytepairs.Encoder(path)
    texts = ["Some  WORDS, İ é 12\n", ""]
    assert own.merges is None
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
