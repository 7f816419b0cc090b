"""The search for titles in texts: one row a text that may be a title, none a position."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thicket import Config
from thicket.functions.grams import character_tables
from thicket.functions.text import fold_case
from thicket.operators.mentions import _found, find_mentions
from thicket.operators.targets import build_dictionary, link_targets


@pytest.mark.parametrize("whole_word", [True, False])
def test_no_row_a_position_and_parts_like_whole(spark, notes, whole_word):
    rng = random.Random(3)
    names = ["Alpha Beta", "Beta", "Çédille ſun", "a-b c.d", "🎉 Party"]
    given = {f"{n}.md": "" for n in names}
    content = " ".join(rng.choice([*names, "alpha", "xBeta", "\n"]) for _ in range(300))
    given["me.md"] = content
    cfg = Config(link_whole_word=whole_word)
    table = notes(given)
    dictionary = build_dictionary(link_targets(table, cfg), cfg, table)
    found = find_mentions(table, dictionary, cfg)
    rows = sorted((r["start"], r["key"]) for r in found.filter("path = 'me.md'").collect())
    assert len(rows) > 150
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
    known = dictionary.title_filter(True)
    for block in (7, 64, 1 << 17):
        parts = _found(pa.array(["", content, None]), block, known).to_pylist()
        assert [len(p["starts"]) for p in parts] == [0, len(rows), 0]
        assert sorted(zip(parts[1]["starts"], parts[1]["keys"], strict=True)) == rows


def test_tables_are_those_of_the_jvm(spark):
    in_word, folded = character_tables(spark)
    sample = "aZ_9 -İIıſΣςµͅé🎉𐐀Ꭰꭰ"
    asked = spark.createDataFrame([(c,) for c in sample], "c string")
    for char, jvm, word in asked.select("c", fold_case(F.col("c")), F.rlike("c", F.lit(r"[\p{L}\p{N}_]"))).collect():
        assert chr(folded[ord(char)]) == jvm and bool(in_word[ord(char)]) == word
