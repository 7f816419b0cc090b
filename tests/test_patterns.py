from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thicket.functions.patterns import compile_patterns, translate


def hits(spark, pattern, *texts):
    (compiled,) = compile_patterns(spark, [pattern])
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    return [r[0] for r in frame.select(compiled.matches(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("pattern", "matching", "other"),
    [
        (r"\bviagra\b", ["éviagra", "VIAGRA!"], ["viagras", "_viagra"]),
        (r"a$", ["ba"], ["a\n", "a b"]),
        (r"^a", ["ab"], ["b\na"]),
        (r"a.b", ["a-b", "a\u0085b"], ["a\nb", "a b"]),
        (r"a\sb", ["a b", "a b", "a﻿b"], ["a​b"]),
        (r"a\Sb", ["a-b"], ["a b"]),
        (r"[[]x", ["[x"], ["x"]),
        (r"[a&&b]x", ["&x", "bx"], ["cx"]),
        (r"a\/b", ["A/B"], ["a b"]),
        (r"x{", ["x{"], ["x"]),
        (r"x{2}y", ["xxy"], ["xy"]),
        (r"\qa", ["qa"], ["a"]),
        (r"[^]z", ["\nz"], ["z"]),
        (r"k", ["K"], ["K"]),
        (r"é", ["É"], ["e"]),
        (r"\w\W", ["a-"], ["ab"]),
        (r"(?<=a)b", ["ab"], ["b"]),
        (r"(a)\1", ["aA"], ["ab"]),
        (r"[\d\s]q", ["1q", "　q"], ["xq"]),
        (r"a\vb", ["a\x0bb"], ["a\nb"]),
        (r"(ab)+c", ["xababc"], ["c"]),
        (r"(?<=a+)b", ["xaab"], ["xb"]),
        (r"a[\S]b", ["a-b", "a\U0001F389b", "a\u200bb"], ["a b", "a\u00a0b", "a\u3000b", "a\ufeffb"]),
        (r"a[^\S]b", ["a b", "a\u00a0b"], ["a-b"]),
        (r"a[\D]b", ["a-b", "a\u0663b", "aéb"], ["a1b"]),
        (r"a[^\D]b", ["a1b"], ["a-b"]),
        (r"a[\W]b", ["a-b", "aéb"], ["a_b", "azb", "a0b"]),
        (r"a[^\W]b", ["a_b", "aZb"], ["a-b", "aéb"]),
        (r"a[\S\s]b", ["a b", "axb"], ["ab"]),
        (r"(x[\S]y)+z", ["qx-yx.yz"], ["x\u00a0yz"]),
        (r"(x[\W]y)+z", ["x-yz", "xéyz"], ["xayz"]),
    ],
)
def test_pattern_dialect(spark, pattern, matching, other):
    assert hits(spark, pattern, *matching) == [True] * len(matching)
    assert hits(spark, pattern, *other) == [False] * len(other)


def test_invalid_and_blank_patterns_are_skipped(spark):
    compiled = compile_patterns(spark, ["(", " ", "a++", "[", "*", "(?P<n>a)", " ok "])
    assert [p.source for p in compiled] == ["(?i)ok"]


def test_repeated_groups_survive_long_texts(spark):
    """The last repeat of a pattern is cut to what it needs and stays in the JVM;
    others leave it, as Java would recurse once per repeat."""
    urls = "https://ex.com/a " * 30_000
    source, recursive = translate(r"(https?:\/\/\S+\s*){5,}")
    assert source.endswith("){5}") and not recursive
    assert hits(spark, r"(https?:\/\/\S+\s*){5,}", urls, urls[:60]) == [True, False]
    assert hits(spark, r"^(https?:\/\/\S+\s+)+end", urls + "end", urls) == [True, False]
    (left_jvm,) = compile_patterns(spark, [r"(a|b)+c"])
    assert not left_jvm.in_jvm
