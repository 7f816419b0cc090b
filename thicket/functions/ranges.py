"""Half-open character ranges inside one note."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.functions.folds import collect, count_below, running
from thicket.functions.once import evaluate_once
from thicket.functions.text import FENCED_CODE, INLINE_CODE, URL

SPANS = "array<struct<start:int,end:int>>"

# Spans that must not be edited, with a text each one contains.
PROTECTED = (
    ("`", FENCED_CODE),
    ("`", INLINE_CODE),
    ("[[", r"\[\[[^\]]*?\]\]"),
    ("](", r"!?\[[^\]]*?\]\([^)]*?\)"),
    ("://", URL),
)


def empty_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def spans_matching(content: Column, pattern: str) -> Column:
    """Where ``pattern`` matches, from the lengths of what is in and between."""

    def steps(hits: Column) -> Column:
        gaps = F.slice(F.split(content, pattern, -1), F.lit(1), F.size(hits))
        return F.zip_with(
            gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("width"))
        )

    def advance(at: Column, step: Column) -> tuple[Column, Column]:
        start = at + step["gap"]
        end = start + step["width"]
        return end, F.array(span(start, end))

    hits = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    return collect(evaluate_once(hits, steps), F.lit(0), advance, SPANS)


def protected_ranges(content: Column) -> Column:
    """Code, links and bare URLs, each kind found on its own, sorted by start."""
    kinds = [
        F.when(
            F.contains(content, F.lit(hint)), spans_matching(content, pattern)
        ).otherwise(empty_spans())
        for hint, pattern in PROTECTED
    ]
    return F.sort_array(F.concat(*kinds))


def overlaps_any(start: Column, end: Column, ranges: Column) -> Column:
    """For a few ranges, in any order."""
    return F.exists(ranges, lambda r: (start < r["end"]) & (end > r["start"]))


def cover(ranges: Column) -> Column:
    """(starts, reach) of ranges sorted by start: how far those up to each one reach."""
    ends = F.transform(ranges, lambda r: r["end"])
    return F.struct(
        F.transform(ranges, lambda r: r["start"]).alias("starts"),
        running(ends, lambda a, b: F.greatest(a, b)).alias("reach"),
    )


def is_covered(start: Column, end: Column, covered: Column) -> Column:
    """Whether ``start`` to ``end`` overlaps a range of ``cover``, by one search in it."""
    before = count_below(covered["starts"], end)
    return F.coalesce(F.get(covered["reach"], before - 1) > start, F.lit(False))
