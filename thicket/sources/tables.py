"""Notes as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import paths


def read_notes(spark: SparkSession, location: str) -> DataFrame:
    """The Markdown notes of a parquet table with at least path and content."""
    table = spark.read.parquet(location)
    return table.filter(paths.is_markdown(F.col("path")))


def spread(table: DataFrame, key: str) -> DataFrame:
    """Use every core on a table stored in few splits, such as one row group (of
    whose splits all but one are empty). A table of many splits or files is left as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    few = table.rdd.getNumPartitions() < 2 * cores and len(table.inputFiles()) < 2 * cores
    return table.repartition(cores, key) if few else table


def with_path_parts(notes: DataFrame) -> DataFrame:
    path = F.col("path")
    return notes.withColumns(
        {
            "name": paths.file_name(path),
            "basename": paths.base_name(path),
            "extension": paths.extension(path),
        }
    )


def write_snapshot(notes: DataFrame, location: str) -> None:
    """Write a new snapshot; an existing one is never overwritten."""
    notes.write.mode("error").parquet(location)


def merge_changes(notes: DataFrame, changed: DataFrame) -> DataFrame:
    """The whole corpus with the content of changed notes replaced."""
    new = changed.select("path", F.col("content").alias("_new"))
    return (
        notes.join(new, "path", "left")
        .withColumn("content", F.coalesce("_new", "content"))
        .drop("_new")
    )
