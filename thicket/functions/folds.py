"""Folds over long arrays, in time that grows with the array.

A fold that appends to its own result copies the result at every step. Here an
array is cut into blocks; results are appended within a block, and blocks to each
other, so an element is copied some ``BLOCK`` times at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.functions.once import evaluate_once

BLOCK = 128


def collect(
    items: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str
) -> Column:
    """What ``step(carry, item)`` yields for each item in order.

    ``step`` returns the next carry and an array of type ``kind``, often of one element or
    none. Null items give null.
    """
    empty = F.array().cast(kind)

    def advance(state: Column, item: Column) -> Column:
        after, found = step(state["carry"], item)
        return F.struct(after.alias("carry"), F.concat(state["out"], found).alias("out"))

    def block_after(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(state["carry"].alias("carry"), empty.alias("out")), advance)
        return evaluate_once(
            inner,
            lambda done: F.struct(
                done["carry"].alias("carry"), F.concat(state["out"], F.array(done["out"])).alias("out")
            ),
        )

    start = F.struct(carry.alias("carry"), F.array().cast(f"array<{kind}>").alias("out"))
    return evaluate_once(items, lambda whole: F.flatten(F.aggregate(_blocks(whole), start, block_after)["out"]))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The first value, it combined with the second, that with the third, and so on; of integers."""

    def step(carry: Column, value: Column) -> tuple[Column, Column]:
        total = F.when(carry.isNull(), value).otherwise(combine(carry, value))
        return total, F.array(total)

    return collect(values, F.lit(None).cast("int"), step, "array<int>")


def count_below(ordered: Column, bound: Column, inclusive: bool = False) -> Column:
    """How many leading elements of an ascending array are below ``bound``, by halving."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        element = F.get(ordered, middle)
        below = element <= bound if inclusive else element < bound
        return F.when(state["low"] >= state["high"], state).otherwise(
            F.struct(
                F.when(below, middle + 1).otherwise(state["low"]).alias("low"),
                F.when(below, state["high"]).otherwise(middle).alias("high"),
            )
        )

    size = F.size(ordered)
    steps = F.length(F.bin(size.cast("bigint")))  # halvings until nothing is left
    start = F.struct(F.lit(0).alias("low"), size.alias("high"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, halve)["low"]


def _blocks(items: Column) -> Column:
    firsts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK))
    return F.transform(firsts, lambda first: F.slice(items, first, BLOCK))
