from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from thicket.llm import alignment
from thicket.llm.public import aligned_tokens

JSON, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "a", "héllo 日本 🎉x\x00y  z", "▁ab cd", "x ▁ y", " lead", "\n\n a  b\n c\t d ", "𒀀𒀁 ab", "  ", "　  x ",
    "<|endoftext|> <s> </s> <0x0A> <unk>", "don't  'S x's  y  z", "naïve ü" * 50, "\x1c a\x1f b\u0085 c​ d",
    "日本語テキスト 中文字符　全角 " * 20, "é á́ 🏴‍☠️ 👩‍👩‍👧", "x" * 3000, " ".join("word%d" % i for i in range(500)),
]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(JSON)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def whole_text_groups(text, libraries):
    """Groups of one text: whole-text ids, decoded token by token, cut where both end."""
    first, second = libraries
    if not text:
        return []
    letters = {}  # of the byte-level alphabet
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    for byte in range(256):
        letters[chr(byte) if byte in plain else chr(256 + sum(o not in plain for o in range(byte)))] = byte
    whole = (" " + text).encode()
    ids_a, ids_b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in ids_a]
    pieces = [second.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    out, a, b, at_a, at_b = [], [], [], 0, 0
    rest = list(zip(ids_b, bytes_b))
    for i, data in zip(ids_a, bytes_a):
        a.append(i)
        at_a += len(data)
        while rest and at_b + len(rest[0][1]) <= at_a:
            b.append(rest[0][0])
            at_b += len(rest.pop(0)[1])
        if at_a == at_b:
            out.append((a, b))
            a, b = [], []
    return out


def brute_force(rows, libraries):
    groups = [whole_text_groups(text, libraries) for _, text, _ in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    counts = Counter(pair for pairs in linked for pair in pairs)
    best: dict[int, int] = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (doc_id, _, _), g, pairs in zip(rows, groups, linked):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append(
            (
                doc_id,
                sum(len(a) for a, _ in g),
                sum(len(b) for _, b in g),
                len(g),
                pairs.total(),
                sum(n for p, n in pairs.items() if counts[p] == best[p[0]]),
                sum(n * counts[p] for p, n in pairs.items()),
                hashlib.sha256(written.encode()).hexdigest() if g else "",
            )
        )
    return out


def got(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in frame.select(names).collect()), key=repr)


def test_matches_brute_force(make_docs, odd_rows, libraries):
    random.seed(3)
    syllables = ["the ", "tion", " of", "é", "日", "\n", "  ", "'s", "🎉", "<s>", "ß ", "12", ".", " "]
    mixed = ["".join(random.choices(syllables, k=random.randint(1, 80))) for _ in range(150)]
    rows = odd_rows + [(100 + i, t, "s") for i, t in enumerate([*ODD, *mixed])]
    assert got(aligned_tokens(make_docs(rows))) == sorted(brute_force(rows, libraries), key=repr)


def test_counts_by_shuffle_equal_counts_by_broadcast(spark, make_docs, libraries):
    rows = [(i, t, "s") for i, t in enumerate(ODD * 3)]
    found = alignment.aligned(make_docs(rows), JSON, MODEL).persist()
    assert got(alignment.counted(found, broadcast_bytes=0)) == got(alignment.counted(found))
    found.unpersist()


def test_groups_read_back():
    assert alignment.groups("日本", JSON, MODEL) == [([10545, 245, 98], [28705, 29142]), ([17312, 105], [29119])]
    assert alignment.groups("", JSON, MODEL) == alignment.groups("▁", JSON, MODEL) == []


def test_chunks_are_forgotten_and_learned_again(monkeypatch, libraries):
    monkeypatch.setattr(alignment, "_KEPT_CHUNKS", 50)
    aligner = alignment.Aligner(JSON, MODEL)
    texts = [f"some {i} words {i * 7} here" for i in range(300)]
    for start in range(0, 300, 20):
        found = aligner.documents(texts[start : start + 20])
        for (facts, digest, _, _), text in zip(found, texts[start:]):
            groups = whole_text_groups(text, libraries)
            written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            assert facts[2] == len(groups) and digest == hashlib.sha256(written.encode()).hexdigest()


def test_dense_groups_are_counted_not_listed(monkeypatch):
    a, b = np.array([5, 5, 7, 1]), np.array([2, 2, 9])
    counts = (np.array([3, 4]), np.array([2, 3]), np.array([3, 1]), np.array([2, 1]))
    listed = alignment._summed(*alignment._linked(a, b, *counts)[:2])
    monkeypatch.setattr(alignment, "_DENSE", 1)
    pairs, times, held = alignment._linked(a, b, *counts)
    assert held.tolist() == [2, 1]
    assert [x.tolist() for x in alignment._summed(pairs, times)] == [x.tolist() for x in listed]


def test_spans_are_cut_by_decoded_bytes():
    spans = np.array([[0, 2], [2, 5], [2, 5], [2, 5], [5, 6]])  # three tokens claim one character
    assert alignment.exact_ends(spans, np.array([2, 1, 1, 1, 1])).tolist() == [2, 3, 4, 5, 6]
    wrong = np.array([[0, 1], [1, 5], [5, 6]])  # a claim that the bytes contradict
    assert alignment.exact_ends(wrong, np.array([2, 3, 1])).tolist() == [2, 5, 6]


def test_empty_table(make_docs):
    assert aligned_tokens(make_docs([])).collect() == []
