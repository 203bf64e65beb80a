"""Both encoders against the tokenizers library on random texts full of white space, marks and specials."""

import inspect
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenstack.llm.bpe import Bpe, encode_bpe, merge_long
from lumenstack.llm.records import ChunkEncoder

ALPHABET = [" ", " ", "\n", "\t", "\r\n", "\u00a0", "a", "b", "the", "Don't", "é", "ß", "Σ", "中", "😀", "9", "12", "!", "...", "<|endoftext|>", "<|", "xyz" * 40]


def texts():
    rng = random.Random(3)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(3000)] + ["", " ", "  ", "\n \n", "q" * 3000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), Bpe(path, 1000)
    for t, ids in zip(texts(), own.encode_batch(texts())):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert own.decode(want) == library.decode(want, skip_special_tokens=False), t


def test_chunk_encoder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), ChunkEncoder(path, 1000)
    for t, ids in zip(texts(), own.encode_batch(pa.array(texts()))):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert [x.tolist() for x in own.encode_batch(pa.array([None, "", None]))] == [[], [], []]
    assert own.encode_batch(pa.array([], pa.string())) == []


def test_long_words_merge_alike():
    own = Bpe(public_tokenizers.path("byte_bpe_50k.json"), 10)
    rng = random.Random(4)
    for n in (2, 30, 300):
        word = "".join(rng.choices("abcdefghij", k=n))
        parts = own.first[np.frombuffer(word.encode(), np.uint8)].tolist()
        own.words.clear()
        own.encode_words([word])
        assert np.frombuffer(own.words[word], "<u4").tolist() == merge_long(parts, own.ranks.single)


def test_a_large_vocabulary_is_encoded_once():
    """Words of many texts stay at hand by default, so that texts with 120,000 words in turn don't merge them again."""
    own = Bpe(public_tokenizers.path("word_bpe_49k.json"), inspect.signature(encode_bpe).parameters["cache_words"].default)
    words = ["".join(x) for x in itertools.islice(itertools.product("aeioubdt", repeat=6), 120_000)]
    batches = [[" ".join(words[i : i + 10_000])] for i in range(0, len(words), 10_000)]
    first = [own.encode_batch(b) for b in batches]
    own.encode_words = lambda new: pytest.fail("merged again") if new else None
    assert [own.encode_batch(b) for b in batches] == first
