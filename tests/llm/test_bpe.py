from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from thicket.llm import bpe
from thicket.llm.public import encoded_digests

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def random_text(seed: int) -> str:
    random.seed(seed)
    alphabet = "aaabbcdé ñß\n\t 'strevml0123 .,-日本語ا🎉 \x1c" + "".join(chr(random.randrange(1, 0xD000)) for _ in range(8))
    return "".join(random.choice(alphabet) for _ in range(random.randrange(400)))


def test_same_ids_as_the_library(words, library):
    texts = [random_text(s) for s in range(200)]
    texts += ["a" * 1000, "ab" * 700, " " * 50 + "x", "don't we'll I'M", "<|endoftext|>", "", "\n\n\n a"]
    assert words.encode(texts) == [library.encode_ordinary(t) for t in texts]
    assert [words.decode(ids).decode() for ids in words.encode(texts)] == texts


def test_small_slabs_and_caches(words, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLAB", 5)
    monkeypatch.setattr(bpe, "CACHE", 3)
    texts = [random_text(s) for s in range(30)]
    assert words.encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_merges_that_make_a_lower_rank():
    """In a table of no training, a merge may make a pair that ought to come first."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"ab": 9, b"abc": 2, b"cd": 5, b"bb": 7, b"ba": 7000}
    table = bpe.Vocabulary.__new__(bpe.Vocabulary)
    table.ranks = ranks
    table.bytes = {r: d for d, r in ranks.items()}
    pairs = sorted(
        (ranks[d[:i]] << 32 | ranks[d[i:]], r) for d, r in ranks.items() for i in range(1, len(d))
        if d[:i] in ranks and d[i:] in ranks
    )
    import numpy as np

    table._single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    table._keys, table._ranks = (np.array(c) for c in zip(*pairs))
    random.seed(4)
    texts = [bytes(random.choice(b"abcd") for _ in range(random.randrange(1, 15))) for _ in range(500)]
    expected = [(ranks[t],) if t in ranks else table._one_by_one(t) for t in texts]
    assert table.replay(texts) == expected


def test_query(make_docs, odd_rows, library):
    found = encoded_digests(make_docs(odd_rows)).collect()
    expected = []
    for doc_id, text, _ in odd_rows:
        ids = library.encode_ordinary(text or "")
        listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc_id, len(ids), listed, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_operators_round_trip(make_docs, odd_rows):
    encoded = bpe.encode(make_docs(odd_rows), PATH, public_tokenizers.PATTERN)
    data = bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), bytes(r["data"])) for r in data) == sorted(
        (str(i), (t or "").encode()) for i, t, _ in odd_rows
    )
    assert bpe.encode(make_docs([]), PATH, public_tokenizers.PATTERN).count() == 0
