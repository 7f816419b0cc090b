"""Shards by a Feistel permutation with cycle walking, in DataFrame functions only.

Rows get global numbers 0 to N - 1. A keyed four-round Feistel network permutes
the domain a x b, the smallest near-square domain that holds N numbers; a result
outside 0 to N - 1 walks the cycle on until it is inside. Position p of the
shuffle is slot p div shards of shard p mod shards. Any row's place can thus be
computed from its number alone, and shard sizes differ by at most one row.

Numbers: rows equal in all output columns are interchangeable and counted first,
so one repeated row may hold any share of the table. Distinct rows are dealt by
hash to ``BUCKETS`` buckets, numbered in each by ``doc_id``, and the sizes of the
earlier buckets added. That is the only shuffle; texts never take part in it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.durable import durable
from thicket.functions.once import computed
from thicket.llm.rows import text_or_empty

BUCKETS = 4096
ROUNDS = 4
_CHUNK = 100_000


def shuffled_shards(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per input row.

    The law is ``rows``: counts at most one apart, slots 0, 1, 2, ... in each
    shard. ``size`` is the UTF-8 bytes of the text (null: none) plus 1. Repeated
    rows and null ids get places of their own; an empty table gives no rows.
    Equal texts are not kept together: the method places each row by its number.
    The place depends on the set of rows, not on files or partitions.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
    )
    numbered, total = number_rows(rows)
    place = numbered.select("doc_id", "size", "text_crc32", computed(_at=permuted(F.col("_number"), total, seed)))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_at"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_at div {int(shards)}").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def number_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``_number`` 0 to N - 1, and N. The order is by hash bucket, then columns."""
    names = rows.columns
    counted = durable(
        rows.groupBy(*names)
        .agg(F.count("*").alias("_n"))
        .withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int"))
    )
    sizes = counted.groupBy("_bucket").agg(F.sum("_n").alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    inside = (
        Window.partitionBy("_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        F.broadcast(starts), "_bucket"  # at most BUCKETS rows
    )
    first = F.col("_start") + F.col("_before")
    chunks = placed.select(
        *names,
        first.alias("_first"),
        "_n",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {_CHUNK}"))).alias("_chunk"),
    )
    from_, to = F.col("_chunk") * _CHUNK, F.least((F.col("_chunk") + 1) * _CHUNK, F.col("_n")) - 1
    each = chunks.select(*names, F.explode(F.sequence(F.col("_first") + from_, F.col("_first") + to)).alias("_number"))
    return each, total


def permuted(number: Column, total: int, seed: int) -> Column:
    """The place of ``number`` in a shuffle of 0 to ``total`` - 1."""
    a, b = domain(total)
    outside = a * b - total
    once = _network(number, a, b, seed)
    if not outside:
        return once
    # A cycle leaves 0 to total - 1 for at most as many steps as there are numbers outside.
    steps = F.sequence(F.lit(1), F.lit(outside))

    def walk(at: Column, _: Column) -> Column:
        return F.when(at < total, at).otherwise(_network(at, a, b, seed))

    return F.get(
        F.transform(
            F.array(once),
            lambda at: F.when(at < total, at).otherwise(F.aggregate(steps, at, walk)),
        ),
        F.lit(0),
    )


def domain(total: int) -> tuple[int, int]:
    """Sides of the permuted rectangle: near-square, at least ``total`` cells, fewer than a row too many."""
    a = math.isqrt(max(total, 1) - 1) + 1
    return a, max(1, -(-total // a))


def _network(number: Column, a: int, b: int, seed: int) -> Column:
    """Alternating rounds on the two digits of ``number`` in the bases a and b."""

    def add(state: Column, turn: int) -> Column:
        left, right = state["l"], state["r"]
        if turn % 2 == 0:
            return F.struct(
                F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(turn)), F.lit(a)), F.lit(a)).alias("l"),
                right.alias("r"),
            )
        return F.struct(
            left.alias("l"),
            F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(turn)), F.lit(b)), F.lit(b)).alias("r"),
        )

    def bound(state: Column, turn: int) -> Column:
        return F.get(F.transform(F.array(state), lambda s: add(s, turn)), F.lit(0))

    start = F.struct(
        F.pmod(number, F.lit(a)).cast("bigint").alias("l"),
        F.floor(number / F.lit(a)).cast("bigint").alias("r"),
    )
    end = reduce(bound, range(ROUNDS), start)
    return F.get(F.transform(F.array(end), lambda s: s["r"] * F.lit(a) + s["l"]), F.lit(0)).cast("bigint")
