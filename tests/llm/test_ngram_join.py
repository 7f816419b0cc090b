from __future__ import annotations

import math
import random

import numpy as np
import pytest

from thicket.llm import ngram_join
from thicket.llm.shingles import Shingler


def sets_of(rows, width):
    out = {}
    for doc_id, text, _ in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        count = max(1, len(words) - width + 1) if words else 0
        out[doc_id] = {tuple(words[i : i + width]) for i in range(count)}
    return out


def brute_force(rows, width, percent):
    """doc_id: (set size, component) by comparing all pairs. Ids are unique here."""
    sets = sets_of(rows, width)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[:at]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(seed, documents=160):
    """Copies of a few texts with more and fewer edits, some texts sharing a long passage."""
    random.seed(seed)
    passage = [f"p{i}" for i in range(40)]
    bases = [[f"g{g}w{random.randrange(300)}" for _ in range(random.choice((3, 20, 80, 160)))] for g in range(7)]
    bases += [passage + [f"q{g}x{i}" for i in range(12)] for g in range(3)]
    rows = []
    for doc_id in range(documents):
        text = list(random.choice(bases[:2] if doc_id % 3 == 0 else bases))
        for _ in range(random.choice((0, 0, 1, 1, 2, 3, 5))):
            text[random.randrange(len(text))] = f"v{random.randrange(30 if doc_id % 2 else 10**6)}"
        if random.random() < 0.2:
            text = text + text[:5]
        rows.append((doc_id, (" " if doc_id % 4 else "\n\t").join(text).upper(), "s"))
    rows += [(1000 + i, t, "s") for i, t in enumerate([None, "", " \t", "one", "ONE", "one two", "a b c", "a b c a b c"])]
    random.shuffle(rows)
    return rows


def found(frame):
    rows = frame.collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}, len(rows)


@pytest.mark.parametrize(
    ("seed", "width", "percent", "crowd"), [(1, 3, 90, 16), (2, 3, 90, 2), (3, 5, 80, 10**6), (4, 2, 60, 5)]
)
def test_components_match_brute_force(make_docs, seed, width, percent, crowd):
    rows = edited(seed)
    got, n = found(ngram_join.linked_documents(make_docs(rows), width, percent, crowd))
    assert n == len(rows) and got == brute_force(rows, width, percent)


def test_order_of_tokens_does_not_matter(make_docs, monkeypatch):
    """With two cells nearly all tokens look alike; links stay the same."""
    rows = edited(5, 90)
    monkeypatch.setattr(ngram_join, "_token_order", lambda *_: np.zeros(2, np.uint8))
    got, _ = found(ngram_join.linked_documents(make_docs(rows), 3, 90))
    assert got == brute_force(rows, 3, 90)


def test_odd_rows(make_docs, odd_rows):
    rows = ngram_join.linked_documents(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert all(r["n_shingles"] == 0 and r["kept"] and r["component_id"] == i for i in (1, 2, 3) for r in by_id[i])
    assert sorted(r["kept"] for r in by_id[4]) == [False, True]  # a repeated row
    assert by_id[6][0]["component_id"] == 5


def test_empty_table(make_docs):
    assert ngram_join.linked_documents(make_docs([])).count() == 0


def test_members_of_one_group_are_verified(make_docs):
    """Sets of one size with the same prefix, which is all that groups know, need not be similar."""
    random.seed(9)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for doc_id in range(120):
        text = list(common)
        for at in random.sample(range(0, 60, 3), k=random.choice((0, 1, 2, 9))):
            text[at] = f"e{random.randrange(12)}"
        rows.append((doc_id, " ".join(text), "s"))
    for crowd in (3, 1000):
        got, _ = found(ngram_join.linked_documents(make_docs(rows), 3, 90, crowd))
        assert got == brute_force(rows, 3, 90)


def test_prefixes_of_similar_sets_meet():
    random.seed(2)
    shingler = Shingler(1)
    for _ in range(300):
        n = random.randint(1, 60)
        words = [f"w{i}".encode() for i in range(n)]
        change = random.randint(0, n // 10)
        other = words[change:] + [f"x{i}".encode() for i in range(random.randint(0, change))]
        similar = 10 * len(set(words) & set(other)) >= 9 * len(set(words) | set(other))
        order = np.array([random.randrange(256) for _ in range(64)], np.uint8)
        a, b = (ngram_join.first_tokens(*shingler.tokens(w), order, 90) for w in (words, other))
        assert len(a) == n - math.ceil(0.9 * n - 1e-9) + 1
        assert not similar or set(a.tolist()) & set(b.tolist())
