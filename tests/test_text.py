from __future__ import annotations

import sys

import pytest
from pyspark.sql import functions as F

from thicket.functions import paths, ranges, text


def column(spark, value, function):
    row = spark.createDataFrame([(value,)], "c string").select(function(F.col("c")).alias("r"))
    return row.first()["r"]


@pytest.mark.parametrize(
    ("given", "words", "urls"),
    [
        ("it's well-known", 3, 0),
        ("snake_case #tag **b**", 4, 0),
        ("https://ex.com/a", 4, 1),
        ("`https://a.b` x", 1, 1),
        ("```\na b\n```", 0, 0),
        ("", 0, 0),
        ("--- ***", 0, 0),
        ("漢字 かな", 2, 0),
        ("don’t", 2, 0),
        ("[a](https://b.c)", 4, 1),
        ("a `b\nc` d", 2, 0),
        ("https://ahttps://b", 3, 1),
        ("HTTP://X", 2, 1),
        ("https://a https://b", 4, 2),
        # A fence inside what looks like one inline span: fences go first.
        ("`a ```x``` b` c", 1, 0),
    ],
)
def test_counts(spark, given, words, urls):
    assert column(spark, given, text.word_count) == words
    assert column(spark, given, text.url_count) == urls


@pytest.mark.parametrize(
    ("given", "left"),
    [
        ("---\na: 1\n---\nbody\n---\nx", "body\n---\nx"),
        ("---\n---\n", "---\n---\n"),
        ("---\na\n---foo", "foo"),
        ("x\n---\na\n---\n", "x\n---\na\n---\n"),
        ("---\r\na\r\n---\r\nb", "b"),
        ("﻿---\na\n---\nb", "﻿---\na\n---\nb"),
    ],
)
def test_strip_frontmatter(spark, given, left):
    assert column(spark, given, text.strip_frontmatter) == left


def test_trim_knows_all_spaces(spark):
    padded = "﻿  \n\t x 　y  \n"
    assert column(spark, padded, text.js_trim) == "x 　y"
    assert column(spark, " \n ", text.js_trim) == ""
    assert column(spark, "x", text.js_trim) == "x"
    # U+0085 and U+200B are no spaces there.
    assert column(spark, "​x\u0085", text.js_trim) == "​x\u0085"


def test_utf16_length_counts_pairs_twice(spark):
    assert column(spark, "🎉🎉a", text.utf16_length) == 5


def test_fold_case_keeps_every_character_in_place(spark):
    """For all code points: one out for one in, words stay words, and the folding
    is the simple one."""
    table = (
        spark.range(1, sys.maxunicode + 1)
        # No surrogates, and no byte order mark, which decoding would drop.
        .filter("id not between 55296 and 57343 and id <> 65279")
        .selectExpr("id AS code", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    )
    word = f"[{text.WORD_CHAR}]"
    odd = (
        table.withColumn("f", text.fold_case(F.col("c")))
        .filter(
            (F.length("f") != 1)
            | (F.rlike("c", F.lit(word)) != F.rlike("f", F.lit(word)))
        )
        # Letters newer than the JVM's own tables are no letters to its regexes.
        .filter(~F.rlike("c", F.lit(r"\p{Cn}")))
        .collect()
    )
    assert odd == []
    folded = {
        row.c: row.f
        for row in table.filter("code < 65536")
        .select("c", text.fold_case(F.col("c")).alias("f"))
        .collect()
    }
    for same in ("KkK", "sſS", "σςΣ", "ßẞ", "ÅåÅ", "µμΜ", "ꭰᎠ"):
        assert len({folded[c] for c in same}) == 1, same
    for apart in ("Iı", "iİ", "ıi", "ée"):
        assert len({folded[c] for c in apart}) == 2, apart
    assert column(spark, "ΟΔΟΣ", text.fold_case) == "οδοσ"


def test_protected_ranges(spark):
    content = "a `b https://x.y/z` ```\nq\n``` [[N|t]] ![i](u) https://e.f g"
    found = column(spark, content, ranges.protected_ranges)
    spans = [content[r["start"] : r["end"]] for r in found]
    assert spans == [
        "`b https://x.y/z`",
        "https://x.y/z`",
        "``",
        "```\nq\n```",
        "`\nq\n`",
        "``",
        "[[N|t]]",
        "![i](u)",
        "https://e.f",
    ]
    assert column(spark, "plain", ranges.protected_ranges) == []
    assert column(spark, "", ranges.protected_ranges) == []


def test_overlap_is_half_open(spark):
    spans = F.array(ranges.span(F.lit(3), F.lit(5)))
    row = spark.range(1).select(
        *(
            ranges.overlaps_any(F.lit(s), F.lit(e), spans).alias(f"r{s}{e}")
            for s, e in [(0, 3), (0, 4), (4, 5), (5, 7)]
        )
    )
    assert list(row.first()) == [False, True, True, False]


def around(spark, content, match):
    start = content.index(match)
    frame = spark.createDataFrame(
        [(content, start, start + len(match))], "c string, s int, e int"
    )
    row = frame.select(
        text.context_around(text.pages(F.col("c")), F.col("s"), F.col("e")).alias("context"),
        text.line_number(text.line_starts(F.col("c")), F.col("s")).alias("line"),
    ).first()
    return row["line"], row["context"]


def test_context_and_line(spark):
    assert around(spark, "one\r\ntwo\n  see Topic now \nend", "Topic") == (3, "see **Topic** now")
    left, right = "l" * 40, "r" * 40
    assert around(spark, f"{left}Topic{right}", "Topic") == (1, f"{left}**Topic**{right}")
    assert around(spark, f"x{left}Topic{right}x", "Topic") == (1, f"…{left}**Topic**{right}…")
    assert around(spark, f"x\n{left}Topic{right}\nx", "Topic") == (2, f"{left}**Topic**{right}")
    assert around(spark, "Topic", "Topic") == (1, "**Topic**")


def test_splice(spark):
    edits = F.array(
        *(
            F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(r).alias("replacement"))
            for s, e, r in [(0, 1, "<é>"), (1, 2, ""), (4, 6, "Z")]
        )
    )
    assert column(spark, "ab🎉def", lambda c: text.splice(text.pages(c), F.length(c), edits)) == "<é>🎉dZ"


def test_wikilink(spark):
    assert column(spark, "Abc", lambda c: text.wikilink(F.lit("Abc"), c)) == "[[Abc]]"
    assert column(spark, "abc", lambda c: text.wikilink(F.lit("Abc"), c)) == "[[Abc|abc]]"


def test_paths(spark):
    assert column(spark, "//a//b/", paths.normalize_path) == "a/b"
    assert paths.normalize_path_text("//a//b/") == "a/b"
    parts = {"a/b.c.md": ("a", "b.c", "md"), "x.md": ("", "x", "md"), "a/.hid": ("a", ".hid", "")}
    for path, (folder, base, ext) in parts.items():
        assert column(spark, path, paths.folder_of) == folder
        assert column(spark, path, paths.base_name) == base
        assert column(spark, path, paths.extension) == ext
