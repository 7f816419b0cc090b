from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from thicket.llm import toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=500):
    """Every fourth document has insults, which are words of one kind or begin alike."""
    random.seed(8)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{random.randrange(300)}" for _ in range(random.randrange(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[random.randrange(len(words))] = random.choice(["badword!", "Nasty", f"zorg{random.randrange(10**6)}"])
        words[10] += "\n"
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_spans(spark, make_docs):
    rows, labels = corpus()
    found = toxicity.score_documents(make_docs(rows), spark.createDataFrame(labels, LABELS)).collect()
    texts = {i: t for i, t, _ in rows}
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.5)
    checked = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in checked]) > 0.97
    words = [texts[r["doc_id"]][int(a) : int(b)] for r in checked if r["spans"] for a, b in [s.split(":") for s in r["spans"].split(",")]]
    right = [w for w in words if all(p.startswith(("badword", "Nasty", "zorg")) for p in w.split())]
    assert len(right) > 0.95 * len(words) > 50


def test_held_out_labels_are_not_read(spark, make_docs):
    rows, labels = corpus(300)
    other = [(i, q, 1 - t if held_out(i) else t) for i, q, t in labels]
    scores = [
        sorted((r["doc_id"], r["score"]) for r in toxicity.score_documents(make_docs(rows), spark.createDataFrame(x, LABELS)).collect())
        for x in (labels, other)
    ]
    assert scores[0] == scores[1]


def test_odd_rows(spark, make_docs, odd_rows):
    rows, labels = corpus(200)
    labels += [(1, None, None), (None, 1, 1), (2, 1, 1), (2, 1, 0)]
    docs = make_docs(odd_rows + [(i + 1000, t, s) for i, t, s in rows])
    shifted = [(None if i is None else i + 1000, q, t) for i, q, t in labels]
    found = toxicity.score_documents(docs, spark.createDataFrame(shifted, LABELS)).collect()
    assert len(found) == len(rows) + len(odd_rows)
    empty = {r["score"] for r in found if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1 and empty.pop() < 0.5
    nobody = toxicity.score_documents(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r["predicted"] for r in nobody} == {0}
    assert toxicity.score_documents(make_docs([]), spark.createDataFrame(labels, LABELS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_marginals_match_enumeration(seed):
    random.seed(seed)
    rng = np.random.default_rng(seed)
    lengths = np.array([random.randrange(1, 7) for _ in range(5)])
    potential, moves = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    marginals, expected = toxicity._Chain(lengths).run(potential, moves)
    start, total = 0, np.zeros((2, 2))
    for n in lengths:
        line = potential[start : start + n]
        mass, toxic, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            states = [(code >> k) & 1 for k in range(n)]
            weight = np.exp(sum(line[k] for k in range(n) if states[k]) + sum(moves[a, b] for a, b in zip(states, states[1:])))
            mass += weight
            toxic += weight * np.array(states)
            for a, b in zip(states, states[1:]):
                pairs[a, b] += weight
        assert np.allclose(marginals[start : start + n], toxic / mass)
        total += pairs / mass
        start += n
    assert np.allclose(expected, total)
