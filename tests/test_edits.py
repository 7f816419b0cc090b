"""Links shown and written in Arrow batches: the same as by the column functions."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from thicket import Config
from thicket.functions import edits as batches
from thicket.functions import once, text
from thicket.operators import edges

EDITS = "path string, content string, edits array<struct<start:int,end:int,target:string>>"


def _described_by_columns(content, edits):
    """The text is cut into pages and lines once."""

    def described(pages, lines):
        def one(e):
            return once.evaluate_once(
                text.page_slice(pages, e["start"], e["end"]),
                lambda matched: F.struct(
                    e["target"].alias("target"),
                    matched.alias("matched_text"),
                    text.line_number(lines, e["start"]).alias("line"),
                    text.context_around(pages, e["start"], e["end"]).alias("context"),
                    e["start"].cast("bigint").alias("start"),
                    e["end"].cast("bigint").alias("end"),
                    text.wikilink(e["target"], matched).alias("replacement"),
                ),
            )

        return F.transform(edits, one)

    return once.evaluate_once(
        text.pages(content),
        lambda pages: once.evaluate_once(text.line_starts(content), lambda lines: described(pages, lines)),
    )


def _linked_by_columns(content, edits):
    def spliced(pages):
        replaced = F.transform(
            edits,
            lambda e: F.struct(
                e["start"],
                e["end"],
                text.wikilink(e["target"], text.page_slice(pages, e["start"], e["end"])).alias("replacement"),
            ),
        )
        return once.evaluate_once(replaced, lambda made: text.splice(pages, F.length(content), made))

    return once.evaluate_once(text.pages(content), spliced)


def test_batches_give_what_columns_give(spark):
    random.seed(5)
    rows = [("none", "", []), ("empty", "no links", [])]
    for n in range(300):
        content = "".join(random.choice("ab \n  é🎉x\u00a0") for _ in range(random.randrange(1, 3000)))
        cuts = sorted(random.sample(range(len(content) + 1), min(2 * random.randrange(1, 9), len(content) // 2 * 2)))
        found = [(a, b, random.choice([content[a:b], "Title"])) for a, b in zip(cuts[::2], cuts[1::2])]
        rows.append((f"{n}", content, found))
    frame = spark.createDataFrame(rows, EDITS).repartition(3)
    content, made = F.col("content"), F.col("edits")
    wrong = frame.select(
        "path",
        edges._described(content, made).alias("a"), _described_by_columns(content, made).alias("b"),
        edges._linked(content, made).alias("c"), _linked_by_columns(content, made).alias("d"),
    ).filter("NOT (a <=> b) OR NOT (c <=> d)")
    assert [row["path"] for row in wrong.collect()] == []


def test_invalid_bytes_are_replaced(spark):
    frame = spark.createDataFrame([("p", "", [(4, 8, "Name")])], EDITS)
    frame = frame.withColumn("content", F.expr("cast(X'61FF620A6E616D65' AS string)"))
    content, made = F.col("content"), F.col("edits")
    linked = [f(content, made) for f in (edges._linked, _linked_by_columns)]
    shown = [f(content, made) for f in (edges._described, _described_by_columns)]
    row = frame.select(*linked, *shown).first()
    assert row[0] == row[1] == "a\ufffdb\n[[Name|name]]"
    assert row[2][0]["line"] == 2 and row[2][0]["matched_text"] == "name" and row[2] == row[3]


def test_spaces_are_those_of_the_pattern():
    spaces = {chr(c) for c in range(0x110000) if re.fullmatch(f"[{text.SPACE}]", chr(c))}
    assert set(batches._SPACE) == spaces


def test_suggestions_are_shown_in_batches(spark, notes):
    found = edges.suggest_links(notes({"a/Some Title.md": "x", "b.md": "of Some Title here"}), Config())
    assert [row["replacement"] for row in found.collect()] == ["[[Some Title]]"]
    assert "described(" in found._jdf.queryExecution().optimizedPlan().toString()
