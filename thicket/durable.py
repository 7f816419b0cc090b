"""Materialise an intermediate result so that losing an executor cannot change it."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# By application: where stored tables go, below the session's folder, and the shared folder itself.
_scratch: dict[str, str] = {}
_base: dict[str, str] = {}


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A
    temporary one is made only where none is set and Spark runs in this process
    alone, which is the case in tests.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Unlike a checkpoint it keeps only the columns that a later step reads in
    memory, and takes about a third of the disk. ``forget`` removes it.
    """
    return written(df, new_folder(df.sparkSession), *partition_by)


def written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a compressed table to ``path`` and read it back."""
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, keep: bool = False) -> str:
    """A fresh path below the shared folder, which all executors can reach.

    With ``keep`` it lies outside the scratch that ``fresh_scratch`` removes.
    """
    scratch = "" if keep else _scratch.get(spark.sparkContext.applicationId, "")
    return "/".join(part for part in (_session_folder(spark), scratch, uuid.uuid4().hex) if part)


def fresh_scratch(spark: SparkSession) -> None:
    """Remove what was stored or checkpointed since the last call, and use a new place from now on.

    For steps that follow one another: a step's result has to be written before the next
    step begins. What was stored before the first call stays.
    """
    application = spark.sparkContext.applicationId
    if application in _scratch:
        _remove(spark, f"{_session_folder(spark)}/{_scratch[application]}")
    _scratch[application] = f"scratch-{uuid.uuid4().hex}"
    folder = f"{_session_folder(spark)}/{_scratch[application]}"
    spark.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    release(spark)


def forget(spark: SparkSession) -> None:
    """Remove every table this session has stored. Frames that read them end here."""
    _remove(spark, _session_folder(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffles of frames that nothing refers to any more.

    Its cleaner acts when the driver collects garbage, which a driver with memory to spare
    may do much later than a disk of the cluster fills.
    """
    gc.collect()
    spark._jvm.System.gc()


def _session_folder(spark: SparkSession) -> str:
    base = _ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/thicket-{spark.sparkContext.applicationId}"


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    application = spark.sparkContext.applicationId
    if application in _base:
        return _base[application]
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not named and not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="thicket-")
    if not current:
        spark.sparkContext.setCheckpointDir(named)
    _base[application] = named or current
    return _base[application]
