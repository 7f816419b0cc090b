from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from thicket.llm import minhash, shingles
from thicket.llm.components import components
from thicket.llm.shingles import Shingler


def brute_force(rows, width):
    """Component and set size by comparing all pairs. Ids are unique here."""
    sets = {}
    for doc_id, text, _ in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        count = max(1, len(words) - width + 1) if words else 0
        sets[doc_id] = {tuple(words[i : i + width]) for i in range(count)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def varied(seed: int):
    """Groups of copies that drift apart, so that some are linked through others only."""
    random.seed(seed)
    rows, doc_id = [], 0
    for group in range(6):
        text = [f"w{random.randrange(400)}" for _ in range(random.choice((6, 40, 120)))]
        for _ in range(random.choice((1, 5, 40))):
            rows.append((doc_id, " ".join(text).upper() if doc_id % 3 else " ".join(text), "s"))
            doc_id += 1
            if random.random() < 0.7:
                text[random.randrange(len(text))] = f"v{random.randrange(999)}"
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width"), [(1, 4), (2, 5)])
def test_components_match_brute_force(make_docs, seed, width):
    rows = varied(seed)
    found = minhash.near_duplicates(make_docs(rows), shingle=width).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found}
    assert len(found) == len(rows) and got == brute_force(rows, width)


def test_odd_rows(make_docs, odd_rows):
    found = minhash.near_duplicates(make_docs(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert all(r["n_shingles"] == 0 and r["kept"] for i in (1, 2, 3) for r in by_id[i])
    assert sorted(r["kept"] for r in by_id[4]) == [False, True]  # a repeated row
    assert by_id[6][0]["component_id"] == 5 and not by_id[6][0]["kept"] and by_id[5][0]["kept"]
    assert sorted(r["n_shingles"] for r in by_id[None]) == [0, 1]


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_columns_of_documents_stay(make_docs):
    docs = make_docs([(1, "a b c d e f", "s"), (2, "A b c d e f", "t"), (3, "x", "t")])
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_signature_estimates_similarity():
    a = [f"w{i}".encode() for i in range(500)]
    sizes, same, bands = minhash.sketch([a, a[:400], list(a), []], Shingler(1))
    assert sizes.tolist() == [500, 400, 500, 0]
    assert same[0] == same[2] != same[1] and (bands[0] == bands[2]).all()
    assert 3 <= (bands[0] == bands[1]).sum() <= 30  # 40 bands of 5 at 0.8: 13 expected


def test_set_sizes_are_exact_whatever_the_words(make_docs):
    """Two words that polynomial hashes modulo 2^64 cannot tell apart, and more words than codes hold."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    found = minhash.near_duplicates(make_docs([(1, f"{thue} x y z {other} x y z", "s")]), shingle=4).first()
    assert found["n_shingles"] == 5
    many = [f"w{i % 5000}".encode() for i in range(12_000)]
    shingler = Shingler(9)
    for words in (many, many[::-1], [b"a"] * 40, [b"a", b"b"]):
        width = min(9, len(words))
        distinct = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        size, tokens = shingler.tokens(words)
        assert size == len(set(tokens.tolist())) == len(distinct)


def test_words_are_forgotten_and_numbered_again(monkeypatch):
    monkeypatch.setattr(shingles, "_KNOWN_WORDS", 10)
    shingler = Shingler(2)
    texts = [[f"w{i}".encode(), f"w{i + 1}".encode(), b"end"] for i in range(50)]
    first = [shingler.tokens(t)[1].tolist() for t in texts]
    assert first == [Shingler(2).tokens(t)[1].tolist() for t in texts]


@pytest.mark.parametrize("seed", [3, 4])
def test_star_of_edited_copies(make_docs, seed):
    """Copies of one text with different edits: many share buckets, few are linked."""
    random.seed(seed)
    base = [f"w{i}" for i in range(150)]
    second = base[:100] + [f"z{i}" for i in range(50)]
    rows = []
    for doc_id in range(140):
        text = list(second if doc_id % 5 == 0 else base)
        for _ in range(random.choice((0, 1, 2, 3, 4, 5, 8, 12))):
            text[random.randrange(len(text))] = f"v{random.randrange(40 if doc_id % 2 else 10**6)}"
        rows.append((doc_id, " ".join(text), "s"))
    random.shuffle(rows)
    found = minhash.near_duplicates(make_docs(rows), shingle=4).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found}
    assert got == brute_force(rows, 4)


def test_a_cluster_linked_with_its_leader_is_not_compared_again(make_docs, monkeypatch):
    random.seed(4)
    rows = []
    for group in range(6):
        text = [f"g{group}w{i}" for i in range(150)]
        copies = [text] + [[f"v{group}x{i}" if k == 10 * i else w for k, w in enumerate(text)] for i in range(8)]
        rows += [(20 * group + i, " ".join(words), "s") for i, words in enumerate(copies)]
    random.shuffle(rows)
    kept = []
    stored = minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    found = minhash.near_duplicates(make_docs(rows, 1)).collect()
    assert all(r["component_id"] == r["doc_id"] // 20 * 20 for r in found)
    changes = [df for df in kept if "changes" in df.columns]
    assert len(changes) == 1 and changes[0].count() == 0


def test_a_hot_component_is_split(make_docs, small_partitions):
    rows = [(i, "one text of some words" if i % 5 else f"text number {i} alone", "s") for i in range(4000)]
    found = minhash.near_duplicates(make_docs(rows, 8)).repartition("doc_id")
    assert found.filter("component_id = 1").count() == 3200
    found.collect()
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
