"""Mix sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target in words. A document of a source whose target is r
times its size is taken floor(r) times for certain; the rest of the target is
drawn as one more copy of some documents. They are ranked by

    random odds / inclusion odds,  u / (1 - u) divided by p / (1 - p)

and taken from the smallest rank on until the target is met: a sample of fixed
size, in words, with unequal probabilities. The inclusion odds of a document are
those of its source times ``size / (size + HALF)``, so that fragments are
repeated less often than documents. (The factor of the source is the same for
all its documents and does not change their order.)

A document that no longer fits is passed over and the filling goes on behind it,
``PASSES`` times; the last one that does not fit is taken if that is nearer.

Scale: texts are read once, for their sizes. Running sums are taken over a
histogram of ranks, and only the bin in which the target is met is sorted, so a
source may hold any share of the rows. Random numbers come from a hash of the
row, so reruns and recomputed partitions agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.durable import durable
from thicket.llm.rows import ROW, salted_join, with_row_ids, word_count
from thicket.operators.ranking import rank_in_group

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
HALF = 64
BINS = 4096
PASSES = 4
_SOURCE = ["_no_source", "_source"]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """One row per input row: ``_thicket_row, doc_id, size, source_size, target, copies, taken``.

    ``size`` counts words (null: 0); ``target`` is the source's, in words;
    ``taken`` is ``size`` times the copies in the mix. Sources in code point
    order, null last, weigh ``weights`` in turn. A target stops at three times
    its source and the excess is shared again. Null sources form one source;
    repeated rows are drawn each for itself; a table without words has targets
    of 0; an empty table gives no rows. Columns other than ``doc_id``, ``text``
    and ``source`` are ignored.
    """
    keep = ROW if ROW in docs.columns else F.monotonically_increasing_id().alias(ROW)
    sized = durable(
        docs.select(
            keep,
            "doc_id",
            F.col("source").isNull().alias("_no_source"),
            F.coalesce("source", F.lit("")).alias("_source"),
            word_count(F.col("text")).alias("size"),
            _uniform(F.xxhash64("doc_id", "text", F.lit(seed))).alias("_u"),
        ).withColumn("_rank", _rank(F.col("_u"), F.col("size")))
    )
    sources = _with_cut(sized, source_targets(sized, weights))
    joined = salted_join(sized, sources, _SOURCE, F.col(ROW))
    key = F.struct("_rank", ROW)
    extra = (
        F.when(F.array_contains("passed", F.col(ROW)), F.lit(False))
        .when(F.col("cut").isNull(), F.lit(True))
        .when(F.col(ROW) == F.col("cut")[ROW], F.col("take_cut"))
        .otherwise(key < F.col("cut"))
    )
    copies = F.col("whole") + F.when(F.col("left") > 0, extra.cast("bigint")).otherwise(0)
    return joined.withColumn("copies", copies).select(
        ROW, "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """``docs`` with every row as often as the mix takes it. Documents without words stay once."""
    keyed = with_row_ids(docs)
    plan = mix(keyed, weights, seed).select(
        ROW, F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(1)).alias("_thicket_copies")
    )
    taken = keyed.join(plan.filter("_thicket_copies > 0"), ROW)
    return taken.withColumn("_thicket_copy", F.explode(F.sequence(F.lit(1), F.col("_thicket_copies").cast("int")))).select(
        *docs.columns
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``_no_source, _source, source_size, target``: one row per source."""
    sums = sized.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size")).withColumn("_all", F.lit(0))
    ranked = rank_in_group(sums, "_all", [F.col(c) for c in _SOURCE], "_place")
    turn = F.pmod(F.col("_place") - 1, F.lit(len(weights))).cast("int")
    weighed = durable(
        ranked.select(
            *_SOURCE,
            "source_size",
            (MOST_COPIES * F.col("source_size")).alias("most"),
            F.get(F.array(*map(F.lit, weights)), turn).cast("bigint").alias("weight"),
        )
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    share, before = 0.0, None
    # Each turn fixes the sources that the share would lift above their limit.
    while share != before:
        full = F.col("weight") * F.lit(share) > F.col("most")
        fixed, free = weighed.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        share, before = ((total - fixed) / free if free else share), share
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(share))
    return weighed.select(*_SOURCE, "source_size", target.alias("target"))


def _uniform(bits: Column) -> Column:
    return (F.pmod(bits, F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _rank(u: Column, size: Column) -> Column:
    """Random odds over inclusion odds, brought to 0..1 by q / (1 + q), which keeps the order."""
    ratio = u / (1 - u) * (size + HALF) / F.when(size > 0, size)
    return F.coalesce(ratio / (1 + ratio), F.lit(1.0))


def _with_cut(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds whole copies and where, in order of rank, a source's extra copies end."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    key = f"struct<_rank:double,{ROW}:bigint>"
    sources = durable(
        targets.withColumn("whole", whole.cast("bigint"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("passed", F.array().cast("array<bigint>"))
        .withColumn("gap", F.col("left"))
        .withColumn("cut", F.lit(None).cast(key))
        .withColumn("cut_size", F.lit(None).cast("bigint"))
        .withColumn("done", F.col("left") <= 0)
    )
    rows = sized.filter("size > 0").select(
        *_SOURCE, ROW, "_rank", "size", F.least(F.floor(F.col("_rank") * BINS), F.lit(BINS - 1)).alias("_bin")
    )
    for turn in range(PASSES):
        sources = durable(_pass(rows, sources, last=turn == PASSES - 1))
    return sources.withColumn("take_cut", F.col("gap") * 2 >= F.col("cut_size")).select(
        *_SOURCE, "source_size", "target", "whole", "left", "passed", "cut", "take_cut"
    )


def _pass(rows: DataFrame, sources: DataFrame, last: bool) -> DataFrame:
    """Fill each source's gap in order of rank up to the first document that does not fit."""
    open_ = sources.filter("NOT done").select(*_SOURCE, "gap", "cut")
    behind = salted_join(rows, open_, _SOURCE, F.col(ROW)).filter(
        F.col("cut").isNull() | (F.struct("_rank", ROW) > F.col("cut"))
    )
    sums = behind.groupBy(*_SOURCE, "_bin").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    upto = Window.partitionBy(*_SOURCE).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    first_over = (
        sums.withColumn("after", F.sum("words").over(upto))
        .filter("after > gap")
        .groupBy(*_SOURCE)
        .agg(F.min(F.struct("_bin", (F.col("after") - F.col("words")).alias("before"))).alias("m"))
        .select(*_SOURCE, "m._bin", "m.before")
    )
    inside = Window.partitionBy(*_SOURCE).orderBy("_rank", ROW).rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        salted_join(behind, first_over, [*_SOURCE, "_bin"], F.col(ROW))
        .withColumn("after", F.col("before") + F.sum("size").over(inside))
        .filter("after > gap")
        .groupBy(*_SOURCE)
        .agg(F.min(F.struct("_rank", ROW, "size", (F.col("after") - F.col("size")).alias("fits"))).alias("m"))
        .select(*_SOURCE, "m.*")
        .select(
            *_SOURCE, F.struct("_rank", ROW).alias("_cut"), F.col("size").alias("_size"), "fits"
        )
    )
    found = F.col("_cut").isNotNull()
    joined = sources.join(cut, _SOURCE, "left")
    passed = F.when(
        found & F.col("cut").isNotNull(), F.concat("passed", F.array(F.col("cut")[ROW]))
    ).otherwise(F.col("passed"))
    ended = ~F.col("done") & ~found  # all that is behind the cut fits
    return joined.select(
        *_SOURCE,
        "source_size",
        "target",
        "whole",
        "left",
        F.when(ended & F.col("cut").isNotNull(), F.concat("passed", F.array(F.col("cut")[ROW])))
        .otherwise(passed)
        .alias("passed"),
        F.when(found, F.col("gap") - F.col("fits")).otherwise(F.col("gap")).alias("gap"),
        F.when(ended, F.lit(None)).otherwise(F.coalesce("_cut", "cut")).alias("cut"),
        F.coalesce("_size", "cut_size").alias("cut_size"),
        (F.col("done") | ended).alias("done"),
    )
