"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.durable import durable
from thicket.functions.once import computed


def shuffled_once(df: DataFrame, *keys: Column) -> DataFrame:
    """Put rows behind a shuffle before they are range-partitioned or sorted.

    Range partitioning reads its input twice, the first time to sample it. Behind
    a shuffle the second reading takes the stored rows; without one, the whole
    scan that made them would run again. The generator keeps the optimizer from
    dropping a shuffle that another one follows.
    """
    return df.repartition(*keys).select(computed(**{c: F.col(c) for c in df.columns}))


def rank_in_group(df: DataFrame, group: str, order: list[Column], rank: str) -> DataFrame:
    """Number the rows of each group 1, 2, 3, ... in ``order``.

    A plain window would sort a whole group in one task. Here the rows are
    range-partitioned by group and order, so a large group spreads over many
    partitions; each numbers its own part, and the sizes of the earlier parts
    are added. Partition borders come from sampling, hence the durable copy:
    a recomputed partition must keep its rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        shuffled_once(df, *order).repartitionByRange(parts, F.col(group), *order).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        placed.groupBy(group, "_part")
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    within = Window.partitionBy(group, "_part").orderBy(*order)
    return (
        placed.withColumn("_local", F.row_number().over(within))
        .join(offsets, [group, "_part"])
        .withColumn(rank, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_local", "_before", "_part")
    )
