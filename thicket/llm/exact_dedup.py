"""Exact duplicates by distributed most-significant-digit radix partitioning.

Texts are compared after every character of ``[\\x20\\x09-\\x0D]`` is deleted.
The first digit of a text is its byte length with its first bytes; later digits
are the bytes that follow, in slices that grow eightfold, so that a text of n
bytes has about log8(n) digits. Each round splits every open group by its next
digit. Groups of one row are closed and leave; groups whose texts have ended are
equal. No digest decides equality: groups are formed on the bytes themselves.

Cost: one shuffle of small rows for the first digit, one of the texts that share
it with another, then each byte of those once. Equal digits are combined before
the shuffle, so a group of any size sends one row a task. Rows are dealt anew
only in groups that really split. Each join has one row a group on its other
side, written before, so adaptive execution cuts a partition that a hot group
makes large (tested).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.durable import durable, stored
from thicket.llm.rows import ROW, SPACE, text_or_empty, with_row_ids

HEAD_BYTES = 32
GROWTH = 8


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, SPACE, "")


def equal_groups(docs: DataFrame) -> DataFrame:
    """``_thicket_row``, ``group``: rows whose texts equal another row's, by group.

    ``docs`` needs ``_thicket_row`` and ``text``. Null counts as empty; empty texts equal
    each other. Rows that equal no other are absent. ``group`` is the smallest
    ``_thicket_row`` of the group.
    """
    whole = docs.select(ROW, normalised(text_or_empty()).cast("binary").alias("bytes"))
    heads = whole.select(
        ROW, F.octet_length("bytes").alias("size"), F.substring("bytes", 1, HEAD_BYTES).alias("head")
    )
    heads = durable(heads)
    first = heads.groupBy("size", "head").agg(F.min(ROW).alias("group"), F.count("*").alias("n"))
    shared = durable(first.filter("n > 1").select("size", "head", "group"))
    groups = durable(
        heads.join(shared, ["size", "head"]).select(ROW, "group", "size")
    )
    longest = groups.agg(F.max("size")).first()[0] or 0
    if longest <= HEAD_BYTES:
        return groups.select(ROW, "group")
    slices = stored(
        whole.join(groups.filter(F.col("size") > HEAD_BYTES), ROW).select(
            ROW, "group", F.inline(_slices(F.col("bytes"), F.col("size"), longest))
        ),
        "digit",
    )
    current = groups.select(ROW, "group")
    moved = None
    for digit in range(len(_bounds(longest))):
        changes = _split(slices.filter(F.col("digit") == digit), moved)
        if changes is None:
            continue
        moved = changes if moved is None else durable(_later(moved, changes))
    if moved is None:
        return current
    return (
        current.join(moved.withColumnRenamed("group", "_moved").withColumn("_hit", F.lit(True)), ROW, "left")
        .filter("_hit IS NULL OR _moved IS NOT NULL")
        .select(ROW, F.coalesce("_moved", "group").alias("group"))
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: ``_thicket_row, doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in its original text stays,
    then the smallest ``doc_id`` (null last), then the smallest ``_thicket_row``, so of
    repeated rows one stays. Needs ``doc_id`` and ``text``; other columns are
    ignored. An empty table gives an empty result.
    """
    keyed = with_row_ids(docs, "doc_id", "text")
    facts = durable(
        keyed.select(
            ROW,
            "doc_id",
            F.char_length(text_or_empty()).alias("points"),
            F.sha2(normalised(text_or_empty()), 256).alias("text_sha256"),
        )
    )
    grouped = durable(facts.join(equal_groups(keyed), ROW, "left"))
    order = F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", ROW)
    best = (
        grouped.filter("group IS NOT NULL")
        .groupBy("group")
        .agg(F.min(order).alias("best"), F.count("*").alias("n"))
        .select("group", F.col("best.doc_id").alias("keep_id"), F.col(f"best.{ROW}").alias("keep_row"), "n")
    )
    # Written first: Spark splits a hot group only where both sides come from a shuffle as they are.
    joined = grouped.join(durable(best), "group", "left")
    return joined.select(
        ROW,
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col(ROW), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each set of equal texts.

    Null counts as empty, and empty texts equal each other; of rows that are the same, one
    stays; an empty table gives no rows. All columns stay.
    """
    keyed = with_row_ids(docs)
    kept = exact_dedup(keyed.select(ROW, "doc_id", "text")).filter("kept")
    return keyed.join(kept.select(ROW), ROW, "left_semi").select(*docs.columns)


def _bounds(longest: int) -> list[tuple[int, int]]:
    """Start and width of the digits after the head, for texts up to ``longest`` bytes."""
    bounds, start, width = [], HEAD_BYTES, HEAD_BYTES * GROWTH
    while start < longest:
        bounds.append((start, width))
        start, width = start + width, width * GROWTH
    return bounds


def _slices(data: Column, size: Column, longest: int) -> Column:
    digits = [
        F.when(
            size > start,
            F.struct(F.lit(i).alias("digit"), F.substring(data, start + 1, width).alias("slice")),
        )
        for i, (start, width) in enumerate(_bounds(longest))
    ]
    return F.filter(F.array(*digits), lambda d: d.isNotNull())


def _split(slices: DataFrame, moved: DataFrame | None) -> DataFrame | None:
    """``_thicket_row``, new ``group`` (null: equals no other) of rows whose group splits here."""
    rows = slices.select(ROW, "group", "slice")
    if moved is not None:
        changed = moved.withColumnRenamed("group", "_moved").withColumn("_hit", F.lit(True))
        rows = (
            rows.join(changed, ROW, "left")
            .filter("_hit IS NULL OR _moved IS NOT NULL")
            .select(ROW, F.coalesce("_moved", "group").alias("group"), "slice")
        )
    parts = rows.groupBy("group", "slice").agg(F.min(ROW).alias("to"), F.count("*").alias("n"))
    split = durable(
        parts.groupBy("group").agg(F.count("*").alias("parts")).filter("parts > 1").select("group")
    )
    if split.isEmpty():
        return None
    open_parts = parts.join(split, "group").select("group", "slice", F.when(F.col("n") > 1, F.col("to")).alias("to"))
    open_parts = durable(open_parts)
    open_rows = rows.join(split, "group")
    return durable(
        open_rows.join(open_parts, ["group", "slice"]).select(ROW, F.col("to").alias("group"))
    )


def _later(moved: DataFrame, changes: DataFrame) -> DataFrame:
    return moved.join(changes, ROW, "left_anti").unionByName(changes)
