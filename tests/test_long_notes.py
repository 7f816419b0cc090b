"""One very long note: results stay right, and no step is quadratic in it (the test would not end)."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from thicket import Config
from thicket.functions import folds, ranges, text
from thicket.operators.edges import apply_links, free_choice, suggest_links


@pytest.fixture
def one(spark):
    def make(content, path="me.md"):
        return spark.createDataFrame([(path, content)], "path string, content string")

    return make


@pytest.fixture
def titles(spark):
    def make(names):
        rows = [(m, m, f"t/{m}.md", 0, len(m)) for m in names]
        return spark.createDataFrame(rows, "match string, target string, path string, ord int, match_len int")

    return make


def test_many_protected_ranges(one):
    n = 60_000
    found = one("`é` x " * n).select(ranges.protected_ranges(F.col("content")).alias("r"))
    size, last, ordered = found.select(
        F.size("r"),
        F.element_at("r", -1),
        F.aggregate("r", F.struct(F.lit(-1).alias("at"), F.lit(True).alias("ok")), lambda s, r: F.struct(
            r["start"].alias("at"), (s["ok"] & (r["start"] - s["at"] == F.when(s["at"] < 0, 1).otherwise(6))).alias("ok")
        ))["ok"],
    ).first()
    assert (size, tuple(last), ordered) == (n, (6 * n - 6, 6 * n - 3), True)


@pytest.mark.parametrize("size", [0, 1, 127, 128, 129, 40_000])
def test_folds_in_blocks(spark, size):
    random.seed(size)
    values = [random.randrange(-5, 9) for _ in range(size)]
    frame = spark.createDataFrame([(values,)], "v array<int>")
    sums, tops, odd = frame.select(
        folds.running(F.col("v"), lambda a, b: a + b),
        folds.running(F.col("v"), F.greatest),
        folds.collect(
            F.col("v"), F.lit(0),
            lambda c, v: (c + 1, F.when(c % 2 == 1, F.array(v)).otherwise(F.array().cast("array<int>"))), "array<int>",
        ),
    ).first()
    total, top, expected_sums, expected_tops = 0, None, [], []
    for v in values:
        total, top = total + v, v if top is None else max(top, v)
        expected_sums.append(total)
        expected_tops.append(top)
    assert (sums, tops, odd) == (expected_sums, expected_tops, values[1::2])


def test_search_in_ascending_arrays(spark):
    for ordered in ([], [3], [1, 1, 1], [0, 2, 2, 5, 9], list(range(0, 900, 3))):
        frame = spark.createDataFrame([(ordered, x) for x in range(-1, 12)], "o array<int>, x int")
        for row in frame.select(
            "x", folds.count_below(F.col("o"), F.col("x")).alias("below"),
            folds.count_below(F.col("o"), F.col("x"), inclusive=True).alias("upto"),
        ).collect():
            assert row["below"] == sum(o < row["x"] for o in ordered)
            assert row["upto"] == sum(o <= row["x"] for o in ordered)


def test_covers(spark):
    random.seed(4)
    for _ in range(5):
        spans = sorted((s, s + random.randrange(9)) for s in (random.randrange(60) for _ in range(12)))
        asked = [(s, s + w) for s in range(0, 70, 2) for w in (1, 4)]
        frame = spark.createDataFrame([(spans, s, e) for s, e in asked], "r array<struct<start:int,end:int>>, s int, e int")
        got = frame.select(ranges.is_covered(F.col("s"), F.col("e"), ranges.cover(F.col("r")))).collect()
        assert [r[0] for r in got] == [any(s < b and e > a for a, b in spans) for s, e in asked]


def test_pages_cut_like_the_text(spark):
    content = "".join(random.Random(1).choices("aé🎉\n", k=3 * text.PAGE + 17))
    places = [(0, 0), (0, 1), (5, text.PAGE), (text.PAGE - 1, text.PAGE + 1), (text.PAGE, text.PAGE),
              (7, 3 * text.PAGE + 5), (3 * text.PAGE, 3 * text.PAGE + 99), (9 * text.PAGE, 9 * text.PAGE + 1)]
    frame = spark.createDataFrame([(content, s, e) for s, e in places], "c string, s int, e int")
    got = frame.select(text.page_slice(text.pages(F.col("c")), F.col("s"), F.col("e"))).collect()
    assert [r[0] for r in got] == [content[s:e] for s, e in places]


@pytest.mark.parametrize("content", ["Topic one `x` ", "`Topic one` ", "Topic one\n"])
def test_many_mentions_of_one_title(one, titles, content):
    found = suggest_links(one(content * 20_000 + "and Topic one"), Config(), titles(["Topic one"])).collect()
    first = 0 if content.startswith("T") else len(content) * 20_000 + 4
    assert [(r["start"], r["line"]) for r in found] == [(first, 1)]


def test_many_titles_without_a_cap(one, titles):
    names = [f"Title {i:05d}" for i in range(20_000)]
    note, cfg = one("\n".join(names)), Config(link_max_per_note=0)
    found = suggest_links(note, cfg, titles(names))
    checked = found.filter(
        (F.col("line") == F.substring("target", 7, 5).cast("bigint") + 1) & (F.col("context") == F.concat(F.lit("**"), "target", F.lit("**")))
    )
    assert found.count() == checked.count() == 20_000
    written = apply_links(note, cfg, targets=titles(names)).first()
    assert written["content"] == "\n".join(f"[[{n}]]" for n in names) and written["n_applied"] == 20_000


def test_free_choice_passes_over_what_is_taken():
    def title(match, starts, *names):
        entries = [{"path": f"{n}.md", "ord": 0, "target": n} for n in names]
        return {"match_len": len(match), "width": len(match), "starts": starts, "entries": entries}

    found = [title("aa", [0, 1, 2, 8], "X"), title("a", [0, 1, 2, 3, 8, 9], "Y", "Z", "me", "old")]
    chosen = free_choice(found, [{"start": 3, "end": 5}, {"start": 9, "end": 99}], "me", ["old"])
    # "aa" at 1 overlaps the one at 0; at 8 it would reach into a protected range.
    assert chosen == [
        {"start": 0, "end": 2, "target": "X"},
        {"start": 2, "end": 3, "target": "Y"},
        {"start": 8, "end": 9, "target": "Z"},
    ]
