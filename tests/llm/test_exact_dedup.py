from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from thicket.llm import exact_dedup


def brute_force(rows):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[2], keep[2], len(members), digest) for m in members]
    return sorted(out, key=str), len(groups)


def check(docs, rows):
    found = exact_dedup.exact_dedup(docs).collect()
    expected, kept = brute_force(rows)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found]
    assert sorted(got, key=str) == expected
    assert sum(r["kept"] for r in found) == kept
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_long_common_beginnings(make_docs):
    """Texts of one length that part ways at the head, in later digits, or at the last byte."""
    random.seed(5)
    base = "".join(random.choice("abcdefgh") for _ in range(20_000))
    rows = []
    for i in range(60):
        text = list(base[: random.choice((10, 32, 33, 288, 289, 3000, 20_000))])
        at = random.choice((0, 31, 32, 287, 288, 2335, len(text) - 1))
        if i % 3 and at < len(text):
            text[at] = random.choice("xyz")
        rows.append((i, "".join(text) + " " * (i % 2), "s"))
    check(make_docs(rows, 5), rows)


def test_odd_rows(make_docs, odd_rows):
    check(make_docs(odd_rows), odd_rows)


def test_one_group_holds_most_rows(make_docs):
    rows = [(i, "same text over and over " * 30, "s") for i in range(500)] + [(1000 + i, f"t{i}", "s") for i in range(50)]
    check(make_docs(rows, 8), rows)


def test_empty_table(make_docs):
    assert exact_dedup.exact_dedup(make_docs([])).count() == 0


def test_columns_of_documents_stay(make_docs):
    docs = make_docs([(1, "a b", "s"), (2, "a  b", "t"), (3, "x", "t")])
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]


def test_a_hot_group_is_split(make_docs, small_partitions):
    """Most rows are copies of one text: the last join deals them to several tasks."""
    rows = [(i, "the same text" if i % 5 else f"text {i}", "s") for i in range(4000)]
    found = exact_dedup.exact_dedup(make_docs(rows, 8)).repartition("doc_id")
    assert found.filter("keep_id = 1").count() == 3200
    found.collect()
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
