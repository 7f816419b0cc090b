from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from thicket.llm import mix, shards


def sources(seed: int = 3):
    random.seed(seed)
    rows = []
    for s, n in (("a", 300), ("b", 40), ("ä", 3), (None, 60), ("c", 0), ("d", 1)):
        rows += [(len(rows) + i, " ".join(["w"] * random.choice((0, 1, 5, 50, 300))), s) for i in range(n)]
    return rows


def targets(rows):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mix.WEIGHTS[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        part = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if part[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else part[s] for s in order}, sizes
        full |= over


def test_targets_and_amounts(make_docs):
    rows = sources()
    found = mix.mix(make_docs(rows, 4)).collect()
    wanted, sizes = targets(rows)
    source_of = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in found:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(wanted[source])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert len(found) == len(rows)
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= max(0.02 * target, 150), source
    again = mix.mix(make_docs(rows, 7)).collect()  # other partitions, same mix
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_mix_of_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    found = mix.mix(docs).collect()
    assert len(found) == len(odd_rows) and all(r["taken"] <= 3 * r["size"] for r in found)
    assert all(r["taken"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    mixed = mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mix.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in found)


def test_mix_of_nothing(make_docs):
    assert mix.mix(make_docs([])).count() == 0
    assert {r["taken"] for r in mix.mix(make_docs([(1, None, None), (2, "", "a")])).collect()} == {0}


def test_fragments_are_repeated_less(make_docs):
    rows = [(i, "w " * (4 if i % 2 else 64), "a") for i in range(400)] + [(1000 + i, "w " * 100, "b") for i in range(200)]
    rows = [(i, t, {"a": "b", "b": "a"}[s]) for i, t, s in rows]
    found = [r for r in mix.mix(make_docs(rows)).collect() if r["doc_id"] < 1000]
    short = [r["copies"] for r in found if r["size"] == 4]
    long = [r["copies"] for r in found if r["size"] == 64]
    assert sum(short) / len(short) < sum(long) / len(long)


@pytest.mark.parametrize("total", [0, 1, 2, 3, 17, 100, 101, 1000])
def test_permutation(spark, total):
    places = spark.range(total).select(shards.permuted(F.col("id"), total, 7).alias("p")).collect()
    assert sorted(r["p"] for r in places) == list(range(total))


def test_shards(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, f"text {i % 7}", "s") for i in range(300)] + [(9, "again", "s")] * 50
    found = shards.shuffled_shards(make_docs(rows)).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in found) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(s) for s in slots.values()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1
    again = shards.shuffled_shards(make_docs(rows, 7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert [r["slot"] for r in sorted(found, key=lambda r: (r["doc_id"] or 0))] != sorted(r["slot"] for r in found)


def test_shards_of_nothing(make_docs):
    assert shards.shuffled_shards(make_docs([])).count() == 0


def test_native_plans(make_docs):
    plan = shards.shuffled_shards(make_docs([(1, "a", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
