from __future__ import annotations

import hashlib
import random

import pytest

from thicket.llm import suffix_dedup, suffix_merge


def brute_force(rows):
    """Every window looked up among all earlier ones."""
    seen, out = set(), []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed: int):
    """Documents that share passages, in part, with small edits, overlapping and next to each other."""
    random.seed(seed)
    letters = "ab" if seed % 2 else "abcdefgh é"
    pool = ["".join(random.choice(letters) for _ in range(random.choice((60, 99, 100, 101, 140, 400)))) for _ in range(12)]
    rows = []
    for doc_id in range(60):
        parts = []
        for _ in range(random.randrange(6)):
            text = random.choice(pool)
            start = random.randrange(len(text) // 2) if random.random() < 0.5 else 0
            text = text[start:]
            if random.random() < 0.3 and text:
                at = random.randrange(len(text))
                text = text[:at] + random.choice("xyz") + text[at + 1 :]
            parts.append(text)
            if random.random() < 0.5:
                parts.append("".join(random.choice(letters) for _ in range(random.randrange(120))))
        rows.append((doc_id, "".join(parts), "s"))
    rows += [(500, "z" * 350, "s"), (501, "zy" * 200, "s"), (502, "z" * 350, "s")]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_matches_brute_force(make_docs, seed):
    rows = passages(seed)
    found = suffix_dedup.remove_repeats(make_docs(rows, 5)).collect()
    assert sorted(map(tuple, found), key=str) == brute_force(rows)


def test_odd_rows(make_docs, odd_rows):
    found = suffix_dedup.remove_repeats(make_docs(odd_rows)).collect()
    assert sorted(map(tuple, found), key=str) == brute_force(odd_rows)


def test_repeated_rows_and_hot_passage(make_docs):
    rows = [(7, "a passage that many share, over and over again, " * 4, "s")] * 3
    rows += [(100 + i, f"{i} own beginning {i * i} " + "another passage of more than fifty words " * 5 + f"{i}", "s") for i in range(300)]
    found = suffix_dedup.remove_repeats(make_docs(rows, 6)).collect()
    assert sorted(map(tuple, found), key=str) == brute_force(rows)


def test_empty_table(make_docs):
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("n_runs", [1, 2, 3, 8, 13])
def test_loser_tree(n_runs):
    random.seed(n_runs)
    words = [bytes(random.choice(b"ab") for _ in range(random.randrange(1, 9))) for _ in range(300)]
    runs = [sorted(words[i::n_runs]) for i in range(n_runs)]
    coded = []
    for run in runs:
        before, out = b"", []
        for word in run:
            out.append((suffix_merge.common(before, word, 0), word, (0, 0, 0)))
            before = word
        coded.append(iter(out))
    merged = list(suffix_merge.merge(coded))
    assert [m[1] for m in merged] == sorted(words)
    before = b""
    for same, word, _ in merged:
        assert same == suffix_merge.common(before, word, 0)
        before = word


def test_front_coding_round_trip():
    random.seed(9)
    run = [(bytes(random.choice(b"abc") for _ in range(100)), d, d + 1, d + 2) for d in range(200)]
    batch = suffix_merge._encoded(list(run), [run[0][0]])
    back = [(s, *place) for row in batch.to_pylist() for _, s, place in suffix_merge._decoded(row)]
    assert sorted(back) == sorted(run)
